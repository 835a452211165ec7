"""Cases with known answers."""

import pytest
from pyspark.sql import functions as F

from glossa.functions import codes as C
from glossa.functions import matching as M
from glossa.functions import normalize as N
from glossa.functions import present as P
from glossa.operators import boundary as B
from glossa.operators import entries as E
from glossa.operators import links as L
from glossa.operators import lookup as K
from glossa.operators import runs as R
from glossa.sources import discs as D
from glossa.sources import files as S
from glossa.sources import textfiles as T
from glossa.streaming import lookups as W


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def folded(s):
    return N.canonical(N.full_width(F.lit(s)), N.KANA_STYLE)


@pytest.mark.parametrize(
    ("a", "b"),
    [("カナ", "かな"), ("abc", "ABC"), ("a b", "ab"), ("カー", "カア"), ("ガ", "カ"), ("パ", "ハ"), ("ｱ", "ア"), ("ｶﾞ", "カ゛"), ("っ", "つ"), ("キャ", "キヤ"), ("ンー", "ンン"), ("カーー", "カアア")],
)
def test_equivalent_words(spark, a, b):
    assert value(spark, folded(a)) == value(spark, folded(b))


@pytest.mark.parametrize(("s", "kind"), [("かな", "kana"), ("カナー", "kana"), ("ａｂｃ１", "alphabet"), ("本", "other"), ("本ａ", "other"), ("ー・", "other"), ("かａ", "other"), ("あ☆", "kana"), ("◎ａ≦", "alphabet"), ("◆あ", "other")])
def test_word_class(spark, s, kind):
    assert value(spark, N.word_class(F.lit(s))) == kind


@pytest.mark.parametrize("s", ["", "  ", "　", "a" * 128, "—", "é", "a🙂", "한", "①"])
def test_words_that_cannot_be_looked_up(spark, s):
    assert value(spark, N.full_width(F.lit(s))) is None


def test_reverse(spark):
    assert value(spark, F.reverse(folded("かなも"))) == "もなか"
    assert value(spark, F.reverse(N.long_vowels(F.lit("カー")))) == "アカ"


def test_long_vowel_after_other_characters_stays(spark):
    assert value(spark, N.long_vowels(F.lit("本ーaー"))) == "本ーaー"


@pytest.mark.parametrize(
    ("text", "want"),
    [("ization", ("ization", False, None)), ("ization*", ("ization", False, None)), ("*ization", ("ization", True, None)), ("  * ization ", ("ization", True, None)), ("*ize*", (None, None, "stars at both ends")), ("*", ("", True, None)), ("**", ("", True, None))],
)
def test_patterns(spark, text, want):
    assert tuple(value(spark, M.parsed_pattern(F.lit(text)))) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("am<sound=1:2>\n", "am\n"), ("<sound=1:2>\nx", "x"), ("a  <image=1:x> b", "a b"), ("a┏me", "am̅e̅"), ("a┓me", "a̅me"), ("Ni┏ho┓n", "Nih̅o̅n"), ("ｈａｓｈｉ", "hashi"), ("①㋐−", "①㋐−")],
)
def test_readable(spark, text, want):
    assert value(spark, P.readable(F.lit(text))) == want


@pytest.mark.parametrize(("text", "width"), [("book", 4), ("辞書", 4), ("é", 1), ("", 0)])
def test_width(spark, text, width):
    assert value(spark, P.display_width(F.lit(text))) == width


def test_truncate_and_pad(spark):
    assert value(spark, P.truncate(F.lit("辞書ツール"), 5)) == "辞書"
    assert value(spark, P.truncate(F.lit("辞書"), 0)) == ""
    assert value(spark, P.pad(F.lit("辞書ツール"), 5)) == "辞書 "


@pytest.mark.parametrize(
    ("text", "columns", "want"),
    [("the quick fox", 9, ["the quick", "fox"]), ("辞書ツール", 4, ["辞書", "ツー", "ル"]), ("abcdefgh", 3, ["abc", "def", "gh"]), ("a\n\nb", 5, ["a", "", "b"]), ("辞書 a", 5, ["辞書 ", "a"])],
)
def test_wrap(spark, text, columns, want):
    assert value(spark, P.wrap_lines(F.lit(text), columns)) == want


def test_packed_decimals_and_positions(spark):
    assert value(spark, C.bcd(F.unhex(F.lit("1268")))) == 1268
    assert value(spark, C.bcd(F.unhex(F.lit("00055452")))) == 55452
    assert value(spark, C.bcd(F.unhex(F.lit("0A")))) is None
    assert tuple(value(spark, C.position(F.lit(2048 * 7 + 5)))) == (8, 5)
    assert value(spark, C.cell_after(F.lit(0xA27E), F.lit(1))) == 0xA321


@pytest.mark.parametrize(("title", "category"), [("英和大辞典", "英"), ("百科事典英語版", "百"), ("広い国語", "国"), ("ＴＨＥＳＡＵＲＵＳ", "英")])
def test_title_category(spark, title, category):
    assert value(spark, P.title_category(F.lit(title))) == category


def test_subscripts(spark):
    assert [value(spark, P.subscript(F.lit(s))) for s in ("12", "ab", "")] == ["₁₂", "(ab)", ""]


def test_carried_header_over_chunks(spark):
    rows = [(i, "header" if i in (0, 50) else "single" if i == 80 else "member", f"k{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "ord long, kind string, key string").withColumn("book", F.lit("b"))
    got = {r.ord: r.group_key for r in R.grouped_entries(df, ["book"], chunk=7).collect()}
    assert got[49] == "k0" and got[79] == "k50" and got[80] is None and got[99] is None and got[50] == "k50"


def test_running_total_over_chunks(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    got = {r.id: r.before for r in R.running_total(df, ["g"], "id", F.col("id"), "before", chunk=9).collect()}
    assert got == {i: sum(range(i % 2, i, 2)) for i in range(100)}


def test_next_different_goes_round(spark):
    df = spark.createDataFrame(list(enumerate("aabbca")), "place long, category string").withColumn("list", F.lit(1))
    got = {r.place: r.n for r in R.next_different(df, ["list"], "place", "category", "n").collect()}
    assert got == {0: 2, 1: 2, 2: 4, 3: 4, 4: 5, 5: 2}
    one = spark.createDataFrame([(0, "a"), (1, "a")], "place long, category string").withColumn("list", F.lit(1))
    assert {r.n for r in R.next_different(one, ["list"], "place", "category", "n").collect()} == {None}


@pytest.mark.parametrize(("counts", "per", "want"), [([2, 2], [1, 1], "a0 b0 a1 b1"), ([1, 3], [1, 1], "a0 b0 b1 b2"), ([3, 3], [2, 1], "a0 a1 b0 a2 b1 b2")])
def test_interleave(spark, counts, per, want):
    rows = [(s, i, p) for s, n, p in zip("ab", counts, per, strict=True) for i in range(n)]
    df = spark.createDataFrame(rows, "s string, ord long, per int")
    got = K.interleaved(df, "s", F.col("s"), F.col("per")).orderBy("place").collect()
    assert " ".join(f"{r.s}{r.ord}" for r in got) == want


def test_single_lookup_is_pushed_to_the_scan(spark, tmp_path, capsys):
    df = spark.createDataFrame([(i, f"key{i}", f"{i}yek", i, 0) for i in range(50)], "ord long, key string, key_rev string, text long, heading long")
    df.write.parquet(str(tmp_path / "e"))
    found = K.lookup(spark.read.parquet(str(tmp_path / "e")), "key1", limit=3)
    assert [r.ord for r in found.collect()] == [1, 10, 11]
    found.explain()
    plan = capsys.readouterr().out
    assert "StringStartsWith(key,key1)" in plan and "TakeOrderedAndProject" in plan


def test_lookup_of_no_queries(spark):
    none = spark.createDataFrame([], "query string, word string")
    entries = spark.createDataFrame([(0, "a", 0, 0)], "ord long, key string, text long, heading long")
    assert K.search(none, entries).count() == 0


def test_stop_choice_prefers_small_offsets_within_the_tie(spark):
    rows = [("s", 0x1F09, 1, 0, 0.97), ("s", 0x1F41, 256, 4, 0.99), ("t", 0x1F09, 1, 0, 0.4)]
    got = B.chosen(spark.createDataFrame(rows, "subbook string, code int, argument int, offset int, score double")).collect()
    assert [(r.subbook, r.code, r.argument) for r in got] == [("s", 0x1F09, 1)]


def test_walks_have_no_row_limit(spark):
    """More rows than a recursive query may have."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        roots = spark.createDataFrame([("r", "R")], "node string, label string")
        edges = spark.createDataFrame([("r", f"n{i}", f"N{i}") for i in range(30)] + [("n3", "m", "M")], "parent string, node string, label string")
        got = L.menu_tree(edges, roots).collect()
        assert len(got) == 32 and [(r.level, r.path) for r in got if r.node == "m"] == [(2, "R > N3 > M")]
        nexts = spark.range(60).selectExpr("'s' subbook", "1 code", "1 argument", "0 offset", "id start", "id + 1 next")
        known = spark.range(59).selectExpr("'s' subbook", "id start")
        read = B.chained(known.where("start % 10 = 0"), nexts, known, depth=7).collect()
        assert sorted(r.start for r in read) == sorted(s + i for s in range(0, 60, 10) for i in range(7))
        assert all(r.good for r in read if r.start < 58)
        with pytest.raises(ValueError):
            L.menu_tree(edges.union(spark.createDataFrame([("m", "r", "R")], edges.schema)), roots, deepest=5)
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_streamed_words_of_any_length_are_answered(spark):
    keys = spark.createDataFrame([("abcdefghijkl",), ("abcdefghxyz",), ("abcdefgh",), ("ab",)], "key string")
    words = spark.createDataFrame([(w,) for w in ("ab", "abcdefgh", "abcdefghi", "abcdefghijkl", "abcdefghijklm", "")], "word string")
    got = W.answered(words, W.beginnings(keys)).groupBy("word").count().collect()
    assert {r.word: r["count"] for r in got} == {"ab": 4, "abcdefgh": 3, "abcdefghi": 1, "abcdefghijkl": 1}


def decoded(spark, *hexes, **how):
    df = spark.createDataFrame([(i, bytes.fromhex(h)) for i, h in enumerate(hexes)], "entry int, bytes binary")
    return {r.entry: r for r in E.entry_texts(E.events(E.tokens(df), **how)).collect()}


def test_stray_bytes_and_stops(spark):
    body = "1F0900011F410160 2361 2362 {} 2363 2364 1F0900011F410160 2365".replace(" ", "")
    got = decoded(spark, body.replace("{}", ""), body.replace("{}", "00"), "2361 1F03 2362".replace(" ", ""), "23611F35236223631F552364", stop=None)
    assert [got[i].text for i in range(4)] == ["ａｂｃｄ", "ａｂｃｄ", "ａ", "ａｄ"]
    assert [got[i].stop for i in range(4)] == ["soft", "soft", "hard", "hard"]


def test_skipped_characters_count(spark):
    """A stop code behind nothing but a skipped region ends the entry; behind an empty one it doesn't."""
    got = decoded(spark, "1F3523611F551F0900012362", "1F351F551F09000123621F090001", stop=(0x1F09, 1))
    assert (got[0].text, got[0].stop, got[1].text) == ("", "soft", "ｂ")


def test_known_stop_code(spark):
    got = decoded(spark, "1F090001 2361 1F090002 2362 1F090001 2363".replace(" ", ""), stop=(0x1F09, 1))
    assert got[0].text == "ａｂ" and got[0].stop == "soft" and got[0].next == 16


def test_menu_line_targets(spark):
    df = spark.createDataFrame([(0, bytes.fromhex("1F4323611F630002647500001F4323621F63000000000000"))], "entry int, bytes binary")
    got = E.spans(E.events(E.tokens(df)), "43", "63").orderBy("start").collect()
    assert [(r.start, r.end, r.page, r.offset) for r in got] == [(0, 1, 26475, 0), (1, 2, None, None)]


def test_variable_leaf(spark):
    page = bytes.fromhex("A0000001") + b"\x02AB" + bytes.fromhex("000000070000" "000000090003")
    df = spark.createDataFrame([(1, page)], "page int, bytes binary")
    got = D.leaf_entries(df).first()
    assert (bytes(got.key), got.text_page, got.heading_page, got.heading_offset) == (b"AB", 7, 9, 3)


def test_unknown_leaf_entry_fails(spark):
    df = spark.createDataFrame([(1, bytes.fromhex("90000001") + b"\x55" * 40)], "page int, bytes binary")
    with pytest.raises(Exception, match="unknown entry"):
        D.leaf_entries(df).collect()


def test_jis_text(spark):
    assert value(spark, D.jis_text(F.unhex(F.lit("242224242020")))) == "あい"
    assert value(spark, D.jis_text(F.unhex(F.lit("2422000024240000")))) == "あ"


def test_plain_files_are_paged(spark):
    df = spark.createDataFrame([(bytes(range(256)) * 16,)], "content binary")
    pages = {r.page: bytes(r.bytes) for r in S.paged(df).collect()}
    assert len(pages) == 2 and pages[1][:4] == b"\0\1\2\3"
    assert len(value(spark, S.byte_range(F.lit(bytes(4096)), F.lit(4090), F.lit(100)))) == 6
    assert value(spark, S.byte_range(F.lit(bytes(16)), F.lit(4), F.lit(0))) == b""


def test_bad_compression_level_fails(spark):
    df = spark.createDataFrame([(b"EBZip\x1f" + bytes(100),)], "content binary")
    with pytest.raises(Exception, match="bad level"):
        S.ebzip_slices(df).collect()


def lines(spark, text):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "path string, line_no int, line string")


def test_mapping_file(spark):
    got = T.gaiji_map(lines(spark, "# comment\n\nha14c\tə\nzb121  —\nha15c\nxyz")).orderBy("line_no").collect()
    assert [(r.narrow, r.code, r.replacement) for r in got[:3]] == [(True, 0xA14C, "ə"), (False, 0xB121, "—"), (True, 0xA15C, "")]
    assert got[3].error == "line 6"


def test_order_file(spark):
    got = T.order_file(lines(spark, "# mine\n/books/plus/\nkojien # good\n")).orderBy("rank").collect()
    assert [r.name for r in got] == ["plus", "kojien"]


def test_appendix(spark):
    got = T.appendix(lines(spark, "character-code JISX0208\nstop-code 0x1f09 0x0001\nbegin narrow\n0xa123\nend\nbegin wide\n0xb122 R,\nend\n0xb123 x\nstop-code 1\nwhat")).orderBy("line_no").collect()
    assert [(r.kind, r.code, r.text, r.error) for r in got] == [
        ("charset", None, "JISX0208", None), ("stop", 0x1F09, None, None), ("char", 0xA123, "", None), ("char", 0xB122, "R,", None),
        ("error", None, None, "character outside a block"), ("error", None, None, "bad stop code"), ("error", None, None, "unknown directive"),
    ]


def test_file_names(spark):
    df = spark.createDataFrame([("d", "HONMON.EBZ;1"), ("d", "Honmon."), ("e", "honmon.ebz"), ("e", "honmon2")], "directory string, name string")
    got = {r.directory: (r.name, r.packed) for r in S.chosen_file(df, F.lit("honmon")).collect()}
    assert got == {"d": ("Honmon.", False), "e": ("honmon.ebz", True)}
