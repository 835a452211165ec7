"""Steps that must stay bounded as tables grow."""

import gzip
import hashlib
import random
import time
import unicodedata as ud
import zlib
from functools import reduce

import duckdb
import pytest
from conftest import rows_of, sql_rows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa import plans
from glossa.functions import codes as C
from glossa.functions import present as P
from glossa.llm import warc
from glossa.operators import entries as E
from glossa.plans import discs
from glossa.sources import files, ranges


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyword_and_broadcasts_no_postings(spark, sf_dir):
    """The postings' file is small at any scale that tests reach, and was broadcast for it."""
    plan = plan_of(plans.QUERIES["keyword_and"](spark, sf_dir))
    assert plan.count("SortMergeJoin [keyword") == 2 and "SortMergeJoin [text" in plan


ODD = ["", "abc", "辞書ツール", "éé́abc", "辞́書〪語", "がぎく", "́a", "辞\x00書\x00x", "a\nb辞\nc", "😀😀ab", "辞\n", "x" * 40, "辞" * 40]


def plain_width(s):
    return sum(0 if ud.combining(c) else 2 if ud.east_asian_width(c) in "WF" else 1 for c in s)


def plain_truncate(s, n):
    out, width = "", 0 if n > 0 else 1  # nothing fits no columns
    for c in s:
        width += plain_width(c)
        if width > n:
            break
        out += c
    return out


def odd_rows(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "n int, s string")


def test_width_against_plain(spark):
    rows = odd_rows(spark).select("s", P.display_width(F.col("s")).alias("x")).collect()
    assert [r.x for r in rows] == [plain_width(r.s) for r in rows]
    assert "&&" in P.WIDE and "&&" in P.COMBINING  # a plain letter is told by one comparison


def test_truncate_against_plain(spark):
    for n in (0, 1, 2, 3, 4, 5, 7, 16):
        rows = odd_rows(spark).select("s", P.truncate(F.col("s"), n).alias("x")).collect()
        assert [r.x for r in rows] == [plain_truncate(r.s, n) for r in rows], n
    assert "aggregate" not in str(P.truncate(F.col("s"), 16))


def test_pad_against_plain(spark):
    for n in (0, 1, 4, 7, 24):
        rows = odd_rows(spark).select("s", P.pad(F.col("s"), n).alias("x")).collect()
        cuts = [plain_truncate(r.s, n) for r in rows]
        assert [r.x for r in rows] == [c + " " * (n - plain_width(c)) for c in cuts], n
    assert str(P.pad(F.col("s"), 24)).count("regexp_extract") == str(P.truncate(F.col("s"), 24)).count("regexp_extract")


def test_wrap_takes_widths_once(spark):
    rows = odd_rows(spark).select("s", P.wrap_lines(F.col("s"), 6).alias("x")).collect()
    assert all(plain_width(line) <= 6 for r in rows for line in r.x)
    assert all("".join(r.x).replace(" ", "") == r.s.replace("\n", "").replace(" ", "") for r in rows)
    assert str(P.wrap_lines(F.col("s"), 6)).count("regexp_count") == 2


def test_raster_makes_its_bits_once():
    assert str(C.raster(F.col("data"), F.lit(8))).count("conv(") == 1


@pytest.fixture(scope="module")
def far_parts(spark, sf_dir, tmp_path_factory):
    """The first parts under numbers of up to nine digits."""
    path = str(tmp_path_factory.mktemp("far"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 60")
    far = [p.withColumn("p_partkey", F.col("p_partkey") + at) for at in (0, 99_960, 1_199_960, 7_199_960, 999_999_920)]
    reduce(DataFrame.unionByName, far).coalesce(1).write.parquet(f"{path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{path}/part.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["src_catalog", "src_catalog_fonts"])
def test_names_of_far_parts(name, spark, far_parts):
    path, con = far_parts
    assert rows_of(plans.QUERIES[name](spark, path)) == sql_rows(con, plans.SQL[name])


def test_page_stream_holds_a_page_at_most(spark):
    """A group's stream was one string, and all of it went along with each of its pages."""
    rows = spark.range(9000).selectExpr("id % 3 AS g", "id DIV 3 AS nth", "repeat(hex(id), cast(id % 7 AS int)) AS v")
    want = {g: "".join(r.v for r in sorted(rows.where(f"g = {g}").collect(), key=lambda r: r.nth)) for g in range(3)}
    pages = discs.page_stream(rows, "g", "nth", F.col("v")).collect()
    assert max(len(r.hex) for r in pages) == 4096
    got = {g: "".join(r.hex for r in sorted((r for r in pages if r.g == g), key=lambda r: r.page)) for g in range(3)}
    assert got == want


def test_numbered_in_two_levels(spark):
    rows = discs.numbered(spark.range(20_000).selectExpr("id % 2 AS g", "id * 3 AS k"), "g", "k").collect()
    assert all(r.nth == r.k // 6 for r in rows)


def test_members_are_read_in_proportion():
    """Members of a long file were read in a time that grew with their square."""
    one = [warc.gzip_members(random.Random(i).randbytes(1200) + b"x" * 3000, 1) for i in range(100)]
    begun = time.process_time()
    found = warc.inflated_members(b"".join(one * 80))
    assert time.process_time() - begun < 5 and found == b"".join(map(gzip.decompress, one)) * 80


def test_short_ranges_share_tasks(spark, tmp_path):
    """A range of 64 KiB was a task, so that their number grew with the table."""
    data = random.Random(7).randbytes(30 << 20)
    (tmp_path / "honmon").write_bytes(data)
    parts = ranges.PageReader({"path": str(tmp_path), "range_bytes": "65536"}).partitions()
    assert len(parts) < 100 and sum(1 + len(p.rest) for p in parts) == 480
    rows = ranges.disc_pages(spark, str(tmp_path), range_bytes=1 << 16).select("page", F.md5("bytes").alias("d")).collect()
    assert len(rows) == 15360 and all(r.d == hashlib.md5(data[(r.page - 1) * 2048 : r.page * 2048]).hexdigest() for r in rows)


@pytest.mark.parametrize("name", ["font_raster", "text_decode", "text_heading", "text_modes", "text_latin"])
def test_long_work_on_rows_is_dealt_out(name, spark, sf_dir):
    """A table of some MB was worked on by the task or two that read it."""
    assert plans.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_tokens_are_dealt_out_by_bytes(spark, monkeypatch):
    """Tokens were shuffled for their windows, into tasks that grew with the table."""
    monkeypatch.setattr(E, "TASK_BYTES", 1000)
    rows = spark.range(500).selectExpr("id AS entry", "unhex(concat('1F41010023', hex(65 + id % 26), '1F6123411F03')) AS bytes")
    toks = E.tokens(rows)
    assert toks.rdd.getNumPartitions() == 500 * 12 // 1000 + 1
    found = E.entry_texts(E.events(toks))
    assert plan_of(found).count("Exchange") == 1  # the entries', before they become tokens
    assert {r.entry: r.text for r in found.collect()} == {i: chr(0xFF21 + i % 26) + "Ａ" for i in range(500)}


def test_texts_are_packed_once_in_small_batches(spark, sf_dir):
    """Batches of 10,000 texts and slices were held whole, in several forms, and each text was packed on both sides of a join."""
    plan = plan_of(plans.QUERIES["src_ebzip"](spark, sf_dir)).split("Initial Plan")[-1]
    assert plan.count("MapInArrow") == 2 and "ArrowEvalPython" not in plan and "Join" not in plan


def test_slices_are_inflated_in_several_batches(spark):
    """More slices than are inflated at once; every third stored as it is, the last one cut at the file's end."""
    n = 2 * files.AT_ONCE + 7
    data = [random.Random(i).randbytes(2048) for i in range(n)]
    rows = [(i, i % 3 == 0, d if i % 3 == 0 else zlib.compress(d), 2048, n * 2048 - 5) for i, d in enumerate(data)]
    slices = spark.createDataFrame(rows, "slice int, raw boolean, data binary, slice_size int, file_size long").coalesce(1)
    found = files.inflated(slices)
    assert found.columns == ["slice", "slice_size", "file_size", "bytes"] and "MapInArrow" in plan_of(found)
    assert {r.slice: bytes(r.bytes) for r in found.collect()} == dict(enumerate([*data[:-1], data[-1][:-5]]))


@pytest.mark.parametrize("name", ["text_candidates", "text_references", "text_events"])
def test_tokens_of_entries_are_never_shuffled(name, spark, sf_dir):
    plan = plan_of(plans.QUERIES[name](spark, sf_dir))
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


@pytest.mark.parametrize("name", ["text_candidates", "text_references", "text_events"])
def test_a_task_has_as_many_entries_at_any_size(name, spark, sf_dir, tmp_path, monkeypatch):
    """Tokens of a table ten times as large met in as few tasks, so that each sorted ten times as many."""
    monkeypatch.setattr(E, "TASK_BYTES", 8192, raising=False)
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey < 200")
    most = []
    for copies in (1, 10):
        path = str(tmp_path / str(copies))
        p.crossJoin(spark.range(copies)).withColumn("p_partkey", F.col("p_partkey") + 200 * F.col("id")).drop("id").write.parquet(f"{path}/part.parquet")
        tasks = plans.QUERIES[name](spark, path).groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(t["count"] for t in tasks) == 200 * copies
        most.append(max(t["count"] for t in tasks))
    assert most[1] < 1.5 * most[0], most


def test_tokens_are_sorted_twice_and_subscripts_collected_once(spark):
    """A task held three sorts of its tokens at once, and each subscript's text four times."""
    rows = spark.createDataFrame([(1, bytes.fromhex("1F06 2331 2332 1F07 2341 1F06 2342 1F07 1F420000 2343 1F62 00000002 0003 1F03"))], "entry long, bytes binary")
    ev = E.events(E.tokens(rows))
    for found in (E.spans(ev, "42", "62"), E.entry_texts(ev)):
        plan = plan_of(found)
        assert plan.count("Sort [entry") == 2 and plan.count("collect_list(_w") == 1
    assert E.entry_texts(ev).first().text == "１２Ａ(Ｂ)Ｃ"
    assert tuple(E.spans(ev, "42", "62").first()) == (1, 6, 7, 2, 3)
