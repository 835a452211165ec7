"""A disc made in a temporary folder, read from its files to its entries."""

import zlib

import pytest
from pyspark.sql import functions as F

from glossa.operators import entries as E
from glossa.sources import discs as D
from glossa.sources import textfiles as T
from glossa.sources.collection import opened
from glossa.sources.files import listed

WORDS = ["ABLE", "BAKER", "CABLE", "ABBOT"]


def jis(s):
    return b"".join(b"\x21\x21" if c == " " else bytes([0x23, ord(c)]) for c in s)


def place(loc):
    return (loc // 2048 + 1).to_bytes(4, "big") + (loc % 2048).to_bytes(2, "big")


def honmon():
    """Page 1: index table; page 2: a leaf; from page 3 on: entries with headings."""
    text, at = b"", {}
    for w in WORDS:
        at[w] = 2 * 2048 + len(text)
        text += bytes.fromhex("1F0900011F410100") + jis(w) + bytes.fromhex("1F611F0A") + jis(w.lower() + " text") + b"\x1f\x0a"
    text += bytes.fromhex("1F03")
    leaf = b"\xa0\x00" + len(WORDS).to_bytes(2, "big")
    for w in sorted(WORDS):
        leaf += bytes([2 * len(w)]) + jis(w) + place(at[w]) * 2
    table = b"\0\x01\0\0\x02".ljust(16, b"\0") + (b"\x91\0" + (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + b"\2\0\0\0").ljust(16, b"\0")
    return table.ljust(2048, b"\0") + leaf.ljust(2048, b"\0") + text, at


def with_keywords():
    """The same disc with a keyword index on page 3 and a copyright and a menu on pages 4 and 5; entries begin on page 6."""
    data, at = honmon()
    at = {w: x + 3 * 2048 for w, x in at.items()}
    rows = {"RED": ["ABLE", "CABLE", "BAKER"], "SHEEP": ["CABLE"], "BIG": ["BAKER", "CABLE"]}
    leaf, n = b"", 0
    for word, texts in sorted(rows.items()):
        if len(texts) == 1:
            leaf += bytes([0, 2 * len(word)]) + jis(word) + place(at[texts[0]]) * 2
        else:
            leaf += bytes([0x80, 2 * len(word)]) + len(texts).to_bytes(4, "big") + jis(word) + place(at[texts[0]])
            leaf += b"".join(b"\xc0" + place(at[t]) for t in texts)
            n += len(texts)
        n += 1
    leaf = b"\xb0\x00" + n.to_bytes(2, "big") + leaf
    record = lambda i, page: (bytes([i, 0]) + page.to_bytes(4, "big") + (1).to_bytes(4, "big") + b"\2\0\0\0").ljust(16, b"\0")
    table = b"\0\x03\0\0\x02".ljust(16, b"\0") + record(0x80, 3) + record(0x02, 4) + record(0x01, 5)
    target = int(str(at["BAKER"] // 2048 + 1), 16).to_bytes(4, "big") + int(str(at["BAKER"] % 2048), 16).to_bytes(2, "big")
    menu = bytes.fromhex("1F02") + jis("to ") + bytes.fromhex("1F43") + jis("BAKER") + bytes.fromhex("1F63") + target + bytes.fromhex("1F0A1F43") + jis("OTHER") + bytes.fromhex("1F63") + bytes(6) + bytes.fromhex("1F03")
    pages = [table, data[2048:4096], leaf, bytes.fromhex("1F02") + jis("FREE") + bytes.fromhex("1F03"), menu]
    return b"".join(p.ljust(2048, b"\0") for p in pages) + data[4096:], at


def ebzip(data):
    cuts = [data[i : i + 2048].ljust(2048, b"\0") for i in range(0, len(data), 2048)]
    slices = [zlib.compress(c) for c in cuts]
    at, offsets = 22 + 2 * (len(slices) + 1), []
    for s in [*slices, b""]:
        offsets.append(at.to_bytes(2, "big"))
        at += len(s)
    return b"EBZip\x10\0\0\0" + len(data).to_bytes(5, "big") + bytes(8) + b"".join(offsets) + b"".join(slices)


def laid_out(tmp_path, data, name):
    (tmp_path / "book" / "WORDS" / "DATA").mkdir(parents=True)
    entry = b"\0\0" + jis("Words").ljust(80, b"\0") + b"WORDS   " + bytes(4) + (1).to_bytes(2, "big")
    (tmp_path / "book" / "CATALOGS").write_bytes(b"\0\1".ljust(16, b"\0") + entry.ljust(164, b"\0"))
    (tmp_path / "book" / "WORDS" / "DATA" / name).write_bytes(data)
    return str(tmp_path)


def test_keywords_menu_and_copyright_of_a_disc(spark, tmp_path):
    data, at = with_keywords()
    c = opened(spark, laid_out(tmp_path, data, "HONMON"))
    words = [(1, 0, "red"), (1, 1, "Sheep"), (2, 0, "red"), (2, 1, "big"), (3, 0, "red"), (4, 0, "big"), (4, 1, "none"), (5, 0, "é"), (6, 0, "red"), (6, 1, " \u3000"), (7, 0, " ")]
    hits = c.keyword_search(spark.createDataFrame(words, "query int, nth int, word string")).orderBy("query", "rank").collect()
    assert [(r.query, r.text) for r in hits] == [(1, at["CABLE"]), (2, at["BAKER"]), (2, at["CABLE"]), (3, at["ABLE"]), (3, at["CABLE"]), (3, at["BAKER"]), (6, at["ABLE"]), (6, at["CABLE"]), (6, at["BAKER"])]
    assert [r.text for r in c.own_texts("copyright").collect()] == ["ＦＲＥＥ"] and c.own_texts("text").count() == 0
    lines = c.menu().orderBy("nth").collect()
    assert [(r.start, r.end, r.label, r.target) for r in lines] == [(3, 8, "ＢＡＫＥＲ", at["BAKER"]), (9, 14, "ＯＴＨＥＲ", None)]


@pytest.mark.parametrize("packed", [False, True])
def test_a_disc_from_end_to_end(spark, tmp_path, packed):
    data, at = honmon()
    laid_out(tmp_path, ebzip(data) if packed else data, "HONMON.EBZ" if packed else "HONMON;1")
    c = opened(spark, str(tmp_path))
    assert [(r.title, r.directory, r.disc) for r in c.subbooks.collect()] == [("Ｗｏｒｄｓ", "WORDS", "EPWING")]
    assert [(r.name, r.start_page, r.end_page) for r in c.indexes.collect()] == [("word_asis", 2, 2)]
    words = spark.createDataFrame([(1, "ab", False), (2, "baker", False), (3, "zz", False), (4, "able", True)], "query int, word string, backward boolean")
    hits = c.search(words)
    assert [(r.query, r.text) for r in hits.orderBy("query", "rank").collect()] == [(1, at["ABBOT"]), (1, at["ABLE"]), (2, at["BAKER"])]
    places = hits.selectExpr("subbook", "text AS location")
    got = {r.location: r for r in c.texts(places).collect()}
    assert got[at["ABLE"]].text == "ＡＢＬＥ\nａｂｌｅ　ｔｅｘｔ\n" and got[at["ABLE"]].stop == "soft"
    assert got[at["ABBOT"]].stop == "hard"
    assert {r.text for r in c.texts(places, heading=True).collect()} == {"ＡＢＬＥ", "ＡＢＢＯＴ", "ＢＡＫＥＲ"}


def with_fields():
    """Two multi searches on pages 2 and 3; the first has a plain field, one of kana and one without an index, whose leaves are pages 4 and 5."""
    record = lambda i, page: (bytes([i, 0]) + page.to_bytes(4, "big") + (1).to_bytes(4, "big") + b"\1").ljust(16, b"\0")
    label = lambda n, s: (bytes([n, 0]) + jis(s)).ljust(32, b"\0")
    table = b"\0\2\0\0\2".ljust(16, b"\0") + record(0xFF, 2) + record(0xFF, 3)
    first = b"\0\3".ljust(16, b"\0") + label(1, "ITEM") + record(0x91, 4) + label(2, "BY") + record(0xA1, 5) + record(0x01, 9) + label(0, "NONE")
    second = b"\0\1".ljust(16, b"\0") + label(1, "ONE") + record(0xB2, 4)

    def leaf(groups):
        out, n = b"", 0
        for key, members in groups:
            out += bytes([0x80, len(key)]) + len(members).to_bytes(4, "big") + key + b"".join(b"\xc0" + place(t) + place(h) for t, h in members)
            n += 1 + len(members)
        return b"\xb0\x00" + n.to_bytes(2, "big") + out

    items = leaf([(jis("LOVE"), [(900, 1), (700, 2), (700, 3)]), (jis("LOVELY"), [(800, 4)])])
    kana = leaf([(bytes.fromhex("242B2437"), [(700, 11), (800, 12)]), (bytes.fromhex("242B"), [(900, 13)])])
    return b"".join(p.ljust(2048, b"\0") for p in (table, first, second, items, kana))


def test_fields_of_a_multi_search(spark, tmp_path):
    c = opened(spark, laid_out(tmp_path, with_fields(), "HONMON"))
    fields = c.multi_fields().orderBy("multi_no", "field_no").collect()
    assert [(r.multi_no, r.field_no, r.label, r.name, r.start_page) for r in fields] == [(0, 0, "ＩＴＥＭ", "0/0/asis", 4), (0, 1, "ＢＹ", "0/1/kana", 5), (0, 2, "ＮＯＮＥ", None, None), (1, 0, "ＯＮＥ", "1/0/asis", 4)]
    words = [
        (1, 0, 0, "love"), (1, 0, 1, "カシ"),
        (2, 0, 0, "love"), (2, 0, 1, " "),
        (3, 0, 1, "か"), (3, 0, 0, "lovely"),
        (4, 0, 0, "love"), (4, 0, 2, "x"),
        (5, 0, 0, " "),
        (6, 1, 0, "love"), (6, 1, 7, "no such field"),
        (7, 0, 0, "é"), (7, 0, 1, "か"),
        (8, 0, 1, "か"),
    ]
    asked = spark.createDataFrame(words, "query int, multi_no int, field_no int, word string")
    rows = lambda df: [(r.query, r.text, r.heading) for r in df.orderBy("query", "rank").collect()]
    plain = [(900, 1), (700, 2), (800, 4)]
    assert rows(c.multi_search(asked)) == [(1, 700, 2), (1, 800, 4), *((2, *x) for x in plain), (3, 800, 4), *((6, *x) for x in plain), (8, 700, 11), (8, 800, 12), (8, 900, 13)]
    assert rows(c.multi_search(asked, exact=True)) == [(1, 700, 2), (2, 900, 1), (2, 700, 2), (6, 900, 1), (6, 700, 2), (8, 900, 13)]
    assert rows(c.multi_search(asked, limit=1)) == [(1, 700, 2), (2, 900, 1), (3, 800, 4), (6, 900, 1), (8, 700, 11)]


def entries_of(n, interruption=b""):
    """Index page and, from page 3 on, n entries that begin with an indent and a keyword; every fourth has the interruption."""
    indent, keyword, body = bytes.fromhex("1F090001"), bytes.fromhex("1F410100"), bytes.fromhex("2424") * 24
    text, leaf = b"", b"\xa0\x04" + n.to_bytes(2, "big")
    for i in range(n):
        leaf += i.to_bytes(4, "big") + place(2 * 2048 + len(text)) + place(0)
        text += indent + keyword + bytes.fromhex("2422") * 3 + bytes.fromhex("1F61") + body
        text += interruption + bytes.fromhex("2426") * 8 + body if interruption and i % 4 == 0 else body
    table = b"\0\1\0\0\2".ljust(16, b"\0") + (b"\x91\0" + (2).to_bytes(4, "big") + (1).to_bytes(4, "big") + b"\2").ljust(16, b"\0")
    return table.ljust(2048, b"\0") + leaf.ljust(2048, b"\0") + text


@pytest.mark.parametrize(("n", "interruption", "expected"), [(20, "1F090001", [(0x1F41, 0x100)]), (7, "", [])])
def test_what_ends_entries_is_read_from_a_disc(spark, tmp_path, n, interruption, expected):
    c = opened(spark, laid_out(tmp_path, entries_of(n, bytes.fromhex(interruption)), "HONMON"))
    stops = c.stop_codes(trials=10, depth=2)
    assert [(r.code, r.argument) for r in stops.collect()] == expected
    if interruption:
        places = stops.select("subbook", F.lit(2 * 2048).cast("long").alias("location"))
        got = c.texts(places, stop=stops).first()
        assert got.stop == "soft" and got.text == "あ" * 3 + "い" * 24 + "う" * 8 + "い" * 24


def test_a_read_end_is_that_of_the_text(spark):
    cases = ["2422242424261F0900012424", "1F09000124221F090001", "1F4200002422", "24221F03", "1F3524241F551F0900012422", "24221F6C", "1F0900011F0900012422", "", "00242224", "24221F4B0000000000001F6B24"]
    rows = spark.createDataFrame(list(enumerate(cases)), "entry int, h string").select("entry", F.unhex("h").alias("bytes"))
    texts = {r.entry: (r.stop, r.next) for r in E.entry_texts(E.events(E.tokens(rows), (0x1F09, 1))).collect()}
    ends = {r.entry: (r.e.stop, r.e.next) for r in rows.select("entry", E.read_end(F.col("bytes"), F.lit("1F090001")).alias("e")).collect()}
    assert {k: ends[k] for k in texts} == texts and ends[7] == ("hard", 0)


def test_honmon_comes_before_honmon2(spark, tmp_path):
    data, at = honmon()
    path = laid_out(tmp_path, ebzip(data), "HONMON.EBZ")
    (tmp_path / "book" / "WORDS" / "DATA" / "HONMON2").write_bytes(b"\0" * 2048)
    assert opened(spark, path).entries().count() == len(WORDS)


@pytest.mark.parametrize("charset", ["iso2022_jp", "euc_jp", "utf-8"])
def test_appendices_are_found_and_decoded(spark, tmp_path, charset):
    (tmp_path / "appendix" / "book").mkdir(parents=True)
    lines = "stop-code 0x1f41 0x0100\nbegin narrow\n0xa121 あ\nend\n"
    (tmp_path / "appendix" / "book" / "words.app").write_bytes(lines.encode(charset))
    home = f"file:{tmp_path}"
    books = [("a", f"{home}/BOOK", "WORDS", None), ("b", f"{home}/other", "WORDS", f"{home}/appendix/"), ("c", f"{home}/x", "NONE", f"{home}/appendix/book/words.app"), ("d", f"{home}/x", "NONE", None)]
    found = T.appendix_of(spark.createDataFrame(books, "subbook string, book string, directory string, where string"), listed(spark, str(tmp_path)))
    got = {r.subbook: (r.path, r.error) for r in found.collect()}
    path = f"{home}/appendix/book/words.app"
    assert got == {"a": (path, None), "b": (path, None), "c": (path, None), "d": (None, "no appendix")}
    rows = T.appendix(T.decoded_lines(spark, path)).orderBy("line_no").collect()
    assert [(r.kind, r.code, r.argument, r.text) for r in rows] == [("stop", 0x1F41, 0x100, None), ("char", 0xA121, None, "あ")]


def test_catalogs_without_subbooks_are_errors(spark):
    for content in (b"\0\0".ljust(16, b"\0"), b"\0\1".ljust(100, b"\0")):
        books = spark.createDataFrame([("b", "EPWING", content)], "book string, disc string, content binary")
        with pytest.raises(Exception, match="catalog: no subbooks"):
            D.catalog(books).collect()
