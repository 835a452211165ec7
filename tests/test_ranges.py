"""Disc pages by ranges, books of other kinds on a disc, menus in circles, and long groups of keyword headings."""

import zlib

import pytest
from pyspark.sql import functions as F

from glossa.operators.decode import Decoder, headings_cut
from glossa.operators.links import reachable
from glossa.operators.stored_index import run_of, write_index
from glossa.sources.collection import opened
from glossa.sources.ranges import PUSHDOWN, FilteredPageReader, PageReader, disc_pages
from test_collection import jis, laid_out, place


def ebzip(data, level=1, spoil=()):
    size = 2048 << level
    slices = [zlib.compress(data[i : i + size].ljust(size, b"\0")) for i in range(0, len(data), size)]
    slices = [b"\xff" + s[1:] if i in spoil else s for i, s in enumerate(slices)]
    at, offsets = 22 + 2 * (len(slices) + 1), []
    for s in [*slices, b""]:
        offsets.append(at.to_bytes(2, "big"))
        at += len(s)
    return b"EBZip" + bytes([0x10 | level]) + b"\0\0\0" + len(data).to_bytes(5, "big") + bytes(8) + b"".join(offsets) + b"".join(slices)


DATA = bytes(i * 7 % 251 for i in range(2048 * 9 + 100))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "HONMON;1").write_bytes(DATA)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "Start.ebz").write_bytes(ebzip(DATA))
    (tmp_path / "b" / "other").write_bytes(b"x" * 5000)
    (tmp_path / "b" / ".START.crc").write_bytes(b"x" * 5000)
    return f"file:{tmp_path}"


def pages(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.path.rsplit("/", 1)[1], {})[r.page] = r.bytes
    return out


def test_a_file_of_many_pages_is_many_tasks(spark, folder):
    options = {"path": folder, "names": "honmon,start", "range_bytes": "4096"}
    parts = PageReader(options).partitions()
    assert sum(p.path.endswith("HONMON;1") for p in parts) == 5 and all(p.high - p.low <= 4096 for p in parts)
    got = pages(disc_pages(spark, folder, names="honmon,start", range_bytes=4096))
    want = {i + 1: DATA[i * 2048 : (i + 1) * 2048] for i in range(10)}
    assert got == {"HONMON;1": want, "Start.ebz": want}


def test_one_page_reads_one_range(spark, folder):
    parts = PageReader({"path": folder, "names": "honmon,start", "range_bytes": "4096", "first": "4", "last": "4"}).partitions()
    assert len(parts) == 2 and {(p.first, p.last) for p in parts} == {(4, 4)}
    got = pages(disc_pages(spark, folder, names="honmon,start", range_bytes=4096, first=4, last=4))
    assert got == {n: {4: DATA[3 * 2048 : 4 * 2048]} for n in ("HONMON;1", "Start.ebz")}
    assert pages(disc_pages(spark, folder, names="start", first=10, last=99)) == {"Start.ebz": {10: DATA[9 * 2048 :]}}
    assert disc_pages(spark, folder, names="none").count() == 0


def test_filters_on_pages_reach_the_source(spark, folder):
    spark.conf.set(PUSHDOWN, "true")
    try:
        df = disc_pages(spark, folder, names="honmon", range_bytes=2048).where("page > 2 AND page <= 4")
        assert df.rdd.getNumPartitions() == 2 and sorted(pages(df)["HONMON;1"]) == [3, 4]
    finally:
        spark.conf.unset(PUSHDOWN)
    assert issubclass(FilteredPageReader, PageReader)


@pytest.mark.parametrize(("mode", "wanted"), [("permissive", [(1, None), (2, None), (3, "e"), (4, "e"), (5, None)]), ("drop", [(1, None), (2, None), (5, None)]), ("failfast", None)])
def test_damaged_slices(spark, tmp_path, mode, wanted):
    (tmp_path / "start").write_bytes(ebzip(DATA[: 2048 * 4 + 9], spoil=(1,)))
    (tmp_path / "honmon").write_bytes(b"EBZip\x1f" + bytes(40))
    df = disc_pages(spark, str(tmp_path), mode=mode)
    if wanted is None:
        with pytest.raises(Exception, match="ebzip"):
            df.collect()
        return
    rows = df.collect()
    assert sorted((r.page, r.error and "e") for r in rows if r.path.endswith("start")) == wanted
    assert [(r.page, r.bytes, bool(r.error)) for r in rows if r.path.endswith("honmon")] == ([(None, None, True)] if mode == "permissive" else [])
    with pytest.raises(ValueError, match="mode"):
        PageReader({"path": str(tmp_path), "mode": "lenient"})


def record(i, page, n=1):
    return (bytes([i, 0]) + page.to_bytes(4, "big") + n.to_bytes(4, "big") + b"\0").ljust(16, b"\0")


def on_pages(*contents):
    return b"".join(c.ljust(2048, b"\0") for c in contents)


def test_an_eb_disc_and_a_latin_one(spark, tmp_path):
    """An EB disc leaves arguments out; a Latin book has a byte a character, in keys, titles and texts."""
    leaf = lambda *keys: b"\x80\x00" + len(keys).to_bytes(2, "big") + b"".join(bytes([len(k)]) + k + place(4096) * 2 for k in keys)
    table = b"\0\1\0\0\0".ljust(16, b"\0") + record(0x91, 2)
    for name, language, title, keys, text in (
        ("eb", None, jis("Old"), [jis("ABLE")], b"\x1f\x02" + jis("x") + b"\x1f\x1a" + b"\x1f\x02" + jis("y") + b"\x1f\x03"),
        ("latin", b"\0\1", b"New book", [b"ABLE", "\xc9T\xc9".encode("latin1")], b"\x1f\x02caf\xe9 \x80\x41x\x1f\x03"),
    ):
        home = tmp_path / name / "DICT"
        home.mkdir(parents=True)
        (tmp_path / name / "CATALOG").write_bytes(b"\0\1".ljust(16, b"\0") + b"\0\0" + title.ljust(30, b"\0") + b"DICT    ")
        if language:
            (tmp_path / name / "LANGUAGE").write_bytes(language.ljust(16, b"\0"))
        (home / "START").write_bytes(on_pages(table, leaf(*keys), text))
    c = opened(spark, str(tmp_path))
    info = {r.title: r for r in c.info().collect()}
    assert {(t, r.disc, r.charset_name, r.searches, r.data_file.rsplit("/", 1)[1]) for t, r in info.items()} == {("Ｏｌｄ", "EB", "JIS X 0208", "word_asis", "START"), ("New book", "EB", "ISO 8859-1", "word_asis", "START")}
    words = spark.createDataFrame([(1, "able", False), (2, "été", False), (3, "あ", False)], "query int, word string, backward boolean")
    hits = c.search(words).collect()
    assert sorted((r.query, r.subbook.split("/")[-2], r.text) for r in hits) == [(1, "eb", 4096), (1, "latin", 4096), (2, "latin", 4096)]
    texts = {r.subbook.split("/")[-2]: r.text for r in c.texts(c.subbooks.select("subbook", F.lit(4096).cast("long").alias("location"))).collect()}
    assert texts == {"eb": "ｘｙ", "latin": "café <gaiji=h8041>x"}


def test_members_need_their_header_and_their_own_key(spark, tmp_path):
    """Groups over two pages: a header that differs hides its members, kana indexes compare members as they were typed."""
    head = lambda k, n: bytes([0x80, len(k)]) + n.to_bytes(2, "big") + k
    member = lambda k, at: bytes([0xC0, len(k)]) + k + place(at) * 2
    kana = lambda s: b"".join(bytes(b & 0x7F for b in ch.encode("euc_jp")) for ch in s)
    table = b"\0\2\0\0\0".ljust(16, b"\0") + record(0x91, 2, 2) + record(0x90, 4)
    plain1 = b"\x90\x00\0\3" + head(jis("AA"), 1) + member(jis("AB"), 100) + head(jis("AB"), 2)
    plain2 = b"\xb0\x00\0\3" + member(jis("AB"), 200) + member(jis("AC"), 300) + bytes([0, 4]) + jis("AB") + place(400) * 2
    folded = b"\xb0\x00\0\5" + head(kana("かあ"), 3) + member(kana("カー"), 500) + member(kana("ガー"), 600) + member(kana("かー"), 700) + bytes([0, 4]) + kana("かあ") + place(800) * 2
    c = opened(spark, laid_out(tmp_path, on_pages(table, plain1, plain2, folded), "HONMON"))
    words = spark.createDataFrame([(1, "ab", False), (2, "aa", False), (3, "カー", False), (4, "ガー", False), (5, "かあ", False)], "query int, word string, backward boolean")
    got = {}
    for r in c.search(words).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.text)
    assert got == {1: [200, 400], 3: [500, 700, 800], 4: [600, 800], 5: [800]}


def test_private_characters_by_title_and_layer(spark, tmp_path):
    """A table for the book's title comes over one for all, in the layers' order; spans count what is shown."""
    table = b"\0\1\0\0\2".ljust(16, b"\0") + record(0x02, 2)
    text = b"\x1f\x04\xa1\x21\x1f\x05\xa1\x21\x1f\x42\0\0\xb1\x22\x1f\x62" + bytes.fromhex("000000050000") + b"\xb1\x23\x1f\x03"
    c = opened(spark, laid_out(tmp_path, on_pages(table, text), "HONMON"))
    rows = [(None, 0, True, 0xA121, "low"), ("Ｗｏｒｄｓ", 1, True, 0xA121, "é"), ("Ｏｔｈｅｒ", 2, True, 0xA121, "no"), ("Ｗｏｒｄｓ", 1, False, 0xA121, ""), (None, 2, False, 0xB122, "long one")]
    tables = spark.createDataFrame(rows, "title string, layer int, narrow boolean, code long, replacement string")
    [got] = c.texts(c.subbooks.select("subbook", F.lit(2048).cast("long").alias("location")), gaiji=tables).collect()
    assert got.text == "élong one<gaiji=zb123>" and got.unknown == "zb123" and [(s.start, s.end, s.page) for s in got.spans] == [(1, 9, 5)]
    [bare] = c.texts(c.subbooks.select("subbook", F.lit(2048).cast("long").alias("location"))).collect()
    assert bare.text == "<gaiji=ha121><gaiji=za121><gaiji=zb122><gaiji=zb123>"


def test_menus_may_lead_in_circles(spark, tmp_path):
    bcd = lambda page: int(str(page), 16).to_bytes(4, "big") + b"\0\1"
    line = lambda s, to: b"\x1f\x43" + jis(s) + b"\x1f\x63" + to + b"\x1f\x0a"
    field = (bytes([1, 0]) + jis("ITEM")).ljust(32, b"\0") + record(0x01, 4)
    table = b"\0\2\0\0\2".ljust(16, b"\0") + record(0x01, 3) + record(0xFF, 2)
    multi = b"\0\1".ljust(16, b"\0") + field
    top = b"\x1f\x02" + line("ONE", bcd(4)) + line("WORD", bytes(6)) + b"\x1f\x03"
    one = b"\x1f\x02" + line("TOP", bcd(3)) + line("SELF", bcd(4)) + line("LEAF", bytes(6)) + b"\x1f\x03"
    c = opened(spark, laid_out(tmp_path, on_pages(table, multi, top, one), "HONMON"))
    rows = sorted((r.level, r.nth, r.label, r.target) for r in c.menu_tree().collect())
    at = lambda page: (page - 1) * 2048 + 1
    below = [("ＴＯＰ", at(3)), ("ＳＥＬＦ", at(4)), ("ＬＥＡＦ", None)]
    assert rows == [(1, 0, "ＯＮＥ", at(4)), (1, 1, "ＷＯＲＤ", None), *((2, i, *x) for i, x in enumerate(below))]
    values = sorted((r.multi_no, r.field_no, r.level, r.label) for r in c.multi_values().collect())
    assert values == sorted([*((0, 0, 1, x[0]) for x in below), (0, 0, 2, "ＯＮＥ"), (0, 0, 2, "ＷＯＲＤ")])
    assert [r.label for r in c.menu_tree(most_levels=1).orderBy("nth").collect()] == ["ＯＮＥ", "ＷＯＲＤ"]
    assert [(r.searches, r.labels) for r in c.info().collect()] == [("menu, multi(1)", ["ＩＴＥＭ"])]


def test_headings_are_cut_one_after_the_other(spark):
    """The bytes are shorter than the stream: a round says where the next has to begin."""
    heads = [jis(w) + b"\x1f\x0a" for w in ("ONE", "TWO", "", "FOUR")]
    data = b"".join(heads)
    rows = spark.createDataFrame([(1, data, [0, 2, 3], 0), (2, data[:12], [0, 1, 3], 0), (3, jis("X") + b"\x1f\x03", [0, 1], 0), (4, b"", [0], 0)], "k int, bytes binary, wanted array<int>, done int").withColumns({"charset": F.lit(2), "epwing": F.lit(True)})
    got = {r.k: ([(x.nth, x.text) for x in r.found], r.done, r.resume) for r in headings_cut(rows, most=12).collect()}
    assert got[1][0][:1] == [(0, "ＯＮＥ")] and got[2] == ([(0, "ＯＮＥ")], 1, 8)
    assert got[3] == ([(0, "Ｘ"), (1, "")], 0, -1) and got[4][0] == [(0, "")]


def test_undefined_codes_do_not_shift_the_others():
    text, stop, after, *_ = Decoder(2, True).read(bytes.fromhex("2422222F2424") + b"\x1f\x03")
    assert len(text) == 3 and text[0] == "あ" and text[2] == "い" and (stop, after) == ("hard", 6)


def test_a_stored_index_splits_equal_keys(spark):
    rows = [(i, "SAME") for i in range(500)] + [(1000 + i, f"K{i:03}") for i in range(300)] + [(2000, None), (2001, "SAMES")]
    index = write_index(spark.createDataFrame(rows, "ord long, key string"), "key", bucket_rows=60)
    assert len(index.firsts) == 14
    asked = spark.createDataFrame([(1, "SAME"), (2, "K0"), (3, "Z"), (4, ""), (5, "SAMES"), (6, None), (7, "SAME")], "query int, word string")
    n = lambda exact: {r.query: r.n for r in index.matched(asked, exact).groupBy("query").agg(F.countDistinct("ord").alias("n")).collect()}
    assert n(False) == {1: 501, 2: 100, 4: 801, 5: 1, 7: 501} and n(True) == {1: 500, 5: 1, 7: 500}
    plan = index.matched(asked)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("Exchange hashpartitioning")[1:] if x.lstrip("(").startswith("ord")]
    index.drop()


def test_a_scan_stops_at_the_first_key_beyond(spark):
    """Words whose runs fill one bucket, several, and none; the order isn't that of the keys."""
    import random

    random.seed(6)
    keys = ["A"] * 40 + ["AB"] * 90 + ["ABC"] * 10 + ["B", "BA", "C"] * 20
    random.shuffle(keys)
    index = write_index(spark.createDataFrame(list(enumerate(keys)), "ord long, key string"), "key", bucket_rows=25)
    words = ["A", "AB", "ABC", "B", "BB", "C", "CC", "", "0"]
    got = {(r.word, r.ord) for r in index.taken_while(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = set()
    for w in words:
        stop = next((i for i, k in enumerate(keys) if k > w and not k.startswith(w)), len(keys))
        want |= {(w, i) for i, k in enumerate(keys[:stop]) if k.startswith(w)}
    assert got == want
    index.drop()


def test_a_search_box_is_replaced_closed_and_counts_late_keys(spark, tmp_path):
    import datetime as dt

    from glossa.plans.streams import updates
    from glossa.streaming.lookups import standing_words

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[(at(0), 1, 1, "a"), (at(1), 1, 2, "ab"), (at(1), 2, 3, "z")], [(at(0), 1, 4, "late"), (at(50), 2, 5, "zz")], [(at(59), 3, 6, "q")], [(at(59), 3, 7, "q")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, user_id long, event_id long, word string").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    stream = spark.readStream.schema("ts timestamp, user_id long, event_id long, word string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    rows = updates(spark, standing_words(stream, delay="5 minutes", idle="20 minutes")).collect()
    opened = [(r.user_id, r.word, r.keystrokes) for r in rows if r.open]
    assert (1, "ab", 2) in opened and (1, "ab", 3) in opened and (3, "q", 1) in opened and (3, "q", 2) in opened
    assert (1, "ab", 3) in [(r.user_id, r.word, r.keystrokes) for r in rows if not r.open]


def test_runs_of_sorted_keys():
    keys = ["a", "ab", "ab", "abc", "b"]
    assert run_of(keys, "ab") == (1, 4) and run_of(keys, "ab", exact=True) == (1, 3) and run_of(keys, "") == (0, 5) and run_of(keys, "c") == (5, 5)


def test_what_can_be_reached(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (2, None), (9, 1)], "source int, target int")
    starts = spark.createDataFrame([(1,), (1,), (4,), (None,)], "node int")
    assert sorted(map(tuple, reachable(edges, starts).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0)]
    assert reachable(edges, starts, most_steps=1).count() == 3
