import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = DATA / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path / '*.parquet' if path.is_dir() else path}'")
    return con


def _plain(v):
    return round(v, 9) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


@pytest.fixture(scope="session")
def agree(spark, duck, sf_dir):
    """Checks that a query and its SQL give the same rows."""

    def check(query, sql):
        assert rows_of(query(spark, sf_dir)) == sql_rows(duck, sql)

    return check
