"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from glossa.llm import gam
from glossa.llm.exact_dedup import exact_dedup
from glossa.llm.licenses import license_scan
from glossa.llm.line_dedup import line_dedup
from glossa.llm.minhash import near_dedup, near_duplicates
from glossa.llm.mixing import mix
from glossa.llm.packing import pack
from glossa.llm.pii import find_personal_data
from glossa.llm.quality_rules import judged, quality_filter
from glossa.llm.warc import gzip_members, read_archives, records, resolve, warc_round_trip, write_archives

public_tokenizers = pytest.importorskip("public_tokenizers")
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ROWS = [
    (1, "a b  c", "en", "s1"), (2, "a b c", "en", "s1"), (2, "a b c", "en", "s1"), (3, None, None, None), (4, "", "en", "s2"),
    (None, "a\tb c", "en", "s1"), (None, None, None, "s2"), (5, LONG, "fr", "s1"), (6, LONG, "fr", "s1"), (7, "x", None, "s3"), (8, " \n\t ", "en", "s3"),
]
CLASHES = ["text_sha256", "keep_id", "kept", "id", "key", "host", "bad", "domain", "epoch", "chunk", "node", "label", "features", "score", "n", "source_order", "rk", "ids", "component_id", "spans", "page", "value"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("other") for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def domain():
    return F.when(F.col("source") == "s1", "web").otherwise("books")


OPERATORS = {
    "license_scan": license_scan,
    "exact_dedup": exact_dedup,
    "packing": lambda d: pack(d, public_tokenizers.path("byte_bpe_50k.json")),
    "near_duplicates": near_duplicates,
    "near_dedup": near_dedup,
    "judged": judged,
    "quality_filter": quality_filter,
    "personal_data": find_personal_data,
    "line_dedup": line_dedup,
    "classifier": lambda d: gam.score(d, gam.train(d, d.select("doc_id", F.lit(1).alias("quality")))),
    "mixing": lambda d: mix(d, domain(), {"web": 2}, {"en": 3}, share=(1, 1)),
    "warc": lambda d: warc_round_trip(d.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit(None).cast("string"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_an_empty_result(name, none):
    assert OPERATORS[name](none).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_do_not_crash(name, docs):
    got = OPERATORS[name](docs).collect()
    if name not in ("packing", "near_dedup", "quality_filter", "mixing"):
        assert len(got) == len(ROWS)


def test_exact_copies(docs):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()), key=repr)
    copies = [x for x in got if x[2] == 4]
    assert copies == [(1, 1, 4, True), (2, 1, 4, False), (2, 1, 4, False), (None, 1, 4, False)]
    assert [x for x in got if x[0] in (5, 6)] == [(5, 5, 2, True), (6, 5, 2, False)]
    assert sum(x[2] == 3 for x in got) == 3 and sum(x[3] for x in got) == 5


def test_repeated_row_keeps_one(spark):
    df = spark.createDataFrame([(2, "a"), (2, "a"), (3, "a")], "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in exact_dedup(df).collect()) == [(2, False), (2, True), (3, False)]


def test_a_salted_content_is_one_group(spark):
    """Half of the rows have one text, some with the same or no id: the runs of the salts meet again."""
    rows = [(i if i % 5 else None, "the  same\ttext") for i in range(600)] + [(1, "the same text")] * 50 + [(1000 + i, f"own {i}") for i in range(600)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    same = [r for r in got if r.group_size > 1]
    assert len(got) == 1250 and {(r.keep_id, r.group_size) for r in same} == {(1, 650)} and len({r.text_sha256 for r in same}) == 1
    assert sum(r.kept for r in same) == 1 and all(r.kept and r.keep_id == r.doc_id for r in got if r.group_size == 1)


def test_near_copies_keep_one_row_of_each_component(docs):
    kept = near_dedup(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "3", "4", "None", "5", "7", "8"])
    assert kept[0].asDict().keys() == set(docs.columns) and all(r[c] == "other" for r in kept for c in CLASHES)
    got = {r.doc_id: r for r in near_duplicates(docs).where("doc_id IS NOT NULL").collect()}
    assert got[4].component_id == 4 and got[4].n_shingles == 0 and got[8].component_id == 8 and got[6].component_id == 5


def test_packing_of_odd_rows(docs):
    got = pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    assert {r.doc_tokens for r in got if r.doc_id in (3, 4)} == {1}
    assert all(len(r.ids) == 4 * r.length for r in got)


def test_lines_of_a_host(spark):
    page = "head\n{}\n\n foot "
    rows = [(i, page.format(f"own {i}"), "h") for i in range(10)] + [(20, "head\nx", None), (21, None, "h"), (22, "", "h"), (23, "head\nhead\ny", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines_dropped) for r in line_dedup(df, ratio=0.5).collect()}
    assert got[3] == ("own 3\n", 2) and got[20] == ("head\nx", 0) and got[21] == (None, 0) and got[22] == ("", 0) and got[23] == ("head\nhead\ny", 0)


def test_a_shortage_goes_to_siblings_first(spark):
    """web/en has a source with hardly any text: its share goes to its sibling, and books keep theirs."""
    rows = [(i, "w " * 10, "en", "big") for i in range(100)] + [(200, "w " * 10, "en", "tiny")] + [(300 + i, "w " * 10, "en", "book") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(df, F.when(F.col("source") == "book", "books").otherwise("web"), {}, {}, budget=800, max_epochs=2).collect()
    n = {s: sum(r.source == s for r in got) for s in ("big", "tiny", "book")}
    assert n == {"big": 38, "tiny": 2, "book": 40}
    assert {r.epoch for r in got if r.source == "tiny"} == {0, 1}


def test_a_whole_branch_in_want_reaches_the_others(spark):
    rows = [(0, "w " * 10, "en", "a")] + [(i, "w " * 10, "en", "b") for i in range(1, 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mix(df, F.col("source"), {}, {}, budget=600, max_epochs=1).collect()
    assert sorted((s, sum(r.source == s for r in got)) for s in "ab") == [("a", 1), ("b", 59)]


@pytest.mark.parametrize("name", ["quality_filter", "line_dedup", "mixing"])
def test_columns_with_clashing_names_keep_their_values(spark, name):
    names = [*CLASHES, "__domain", "o", "full", "rest", "doc", "lines", "good", "digest", "keys", "pages", "row", "of"]
    text = " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60) for w in ("plain", "word", "number"))
    df = spark.createDataFrame([(i, text + f" {i}", "en", "s1") for i in range(9)], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = OPERATORS[name](df.withColumns({c: F.lit("mine") for c in names})).collect()
    assert got and all(r[c] == "mine" for r in got for c in names if not (name == "mixing" and c in ("domain", "epoch")))


def test_copies_of_a_text_are_one_page_of_their_host(spark):
    rows = [(i, "head\nsame text", "h") for i in range(30)] + [(100 + i, f"own {i}\nmore", "h") for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == "head\nsame text" and got[107] == "own 7"


def test_archives_of_odd_rows(spark):
    rows = [(1, "http://a\r\nX: y", "p\r\n\r\nWARC/1.1 q"), (2, None, "p\r\n\r\nWARC/1.1 q"), (3, "http://c", None), (4, "http://d", ""), (None, None, "z")]
    got = {r.page_id: r for r in warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[2].record_type, got[1].record_type, got[1].refers_to, got[1].payload_bytes) == ("response", "revisit", 2, 15)
    assert got[1].payload_digest == got[2].payload_digest and got[4].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert (got[3].record_type, got[3].refers_to, got[None].record_type) == ("revisit", 4, "response")


def test_archives_hold_a_member_for_each_record(spark, tmp_path):
    import zlib

    rows = [(i, f"http://h/{i}", f"page {i // 2} " + "é" * 300) for i in range(40)]
    write_archives(records(resolve(spark.createDataFrame(rows, "page_id long, url string, html string"))), f"file://{tmp_path}/out", file_bytes=2000)
    members = []
    files = sorted((tmp_path / "out").glob("part-*"))
    for f in files:
        data = f.read_bytes()
        while data:
            one = zlib.decompressobj(31)
            members.append(one.decompress(data))
            assert one.eof
            data = one.unused_data
    assert len(members) == 40 and all(m.startswith(b"WARC/1.1") and m.endswith(b"\r\n\r\n") for m in members) and len(files) > 2
    back = {r.page_id: r for r in read_archives(spark, f"file://{tmp_path}/out").collect()}
    assert back["3"].payload.decode() == rows[3][2] and back["2"].payload is None
    assert all(r.refers_to == back[str(int(k) + 1)].record_id for k, r in back.items() if r.record_type == "revisit")


def test_a_large_record_is_several_members():
    import gzip

    record = bytes(range(256)) * 100
    out = gzip_members(record, most=1000)
    assert gzip.decompress(out) == record and out.endswith(b"\x00")
