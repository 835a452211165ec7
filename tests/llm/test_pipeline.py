"""The pipeline against plain versions of its stages."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from glossa.llm.common import written
from glossa.llm.quality_rules import RULES, Measures

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert kept[0] == {k: t for k, t in first.items() if not any(rule(Measures(t)) for rule in RULES.values())}
    hosts = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert kept[1] == brute.without_boilerplate(kept[0], hosts)
    groups = brute.components(kept[1], size=5)
    assert set(kept[2]) == {k for k, (_, c) in groups.items() if k == c}
    assert set(kept[3]) <= set(kept[2]) and kept[3]

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    drawn = [r.doc_id for r in docs.collect()]
    ids = {k: tok.encode(t, add_special_tokens=False).ids + [1] for k, t in kept[3].items()}
    assert sum(p.length for p in pieces) == sum(len(ids[k]) for k in drawn)
    assert {p.doc_id for p in pieces} == set(drawn)


def test_mixing_equals_its_sql_on_what_near_dedup_keeps(spark, sf_dir, tmp_path):
    """The drawn rows of the stage, with their number, against the operator's SQL with the stage's share of the tokens."""
    import duckdb

    from glossa.llm.queries import MIX_SQL

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in ("quality_rules", "line_dedup", "near_dedup"):
        docs = written(stages[name](spark, docs, sf_dir), name)
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    sql = MIX_SQL.replace("FROM l) // 2", "FROM l) * 4 // 5")
    assert sql != MIX_SQL
    want = con.execute(f"SELECT doc_id, count(*) FROM ({sql}) GROUP BY doc_id").fetchall()
    got = stages["mixing"](spark, docs, sf_dir).groupBy("doc_id").count().collect()
    assert sorted((r.doc_id, r["count"]) for r in got) == sorted(want) and len(want) > 20


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]


def test_one_full_copy_leaves_near_dedup(spark, sf_dir):
    """A third of a source is one text: line dedup leaves it whole, and near-dedup keeps one row of it."""
    text = lambda k: "\n".join(["a line of every page", *(" ".join(f"w{k}x{j}y{i}" for i in range(12)) for j in range(6))])
    rows = [(i, text(0 if i < 30 else i), "en", "s") for i in range(90)] + [(100 + i, text(0 if i < 3 else 100 + i), "en", None) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    stages = dict(corpus_pipeline.STAGES)
    docs = written(stages["line_dedup"](spark, df.repartition(5), sf_dir), "line_dedup")
    own = {i: t.split("\n", 1)[1] for i, t, _, _ in rows}
    assert {r.doc_id: r.text for r in docs.collect()} == own
    kept = stages["near_dedup"](spark, docs, sf_dir).collect()
    assert [r.doc_id for r in kept if r.text == own[0]] == [0]
    assert sorted(r.doc_id for r in kept) == [0, *range(30, 90), *range(103, 109)]


def test_odd_rows_pass_through_every_stage(spark, sf_dir):
    """Nulls, rows without words and repeated rows; and an empty table, which gives an empty one at each stage."""
    letters = str.maketrans("0123456789", "abcdefghij")
    long = lambda k: "\n".join(" ".join(f"w{k}x{j}y{i}".translate(letters) for i in range(12)) for j in range(8))
    rows = [(1, None, None, None), (2, "", "en", "src1"), (3, " \n\t", None, "src1"), (None, long(99), None, None), (None, None, "en", None)]
    rows += [(10 + i, long(i // 2), "en", "src1") for i in range(20)] + [(10, long(0), "en", "src1")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, none = written(stage(spark, docs, sf_dir), name), written(stage(spark, none, sf_dir), name)
        assert none.isEmpty()
        if name == "near_dedup":
            assert sorted(str(r.doc_id) for r in docs.collect()) == sorted([*map(str, range(10, 30, 2)), "None"])
    pieces, nothing = (corpus_pipeline.STAGES[-1][1](spark, d, sf_dir) for d in (docs, none))
    assert nothing.isEmpty() and {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
