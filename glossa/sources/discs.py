"""Decoding a disc's tables: catalogs, index tables, multi-field tables, index leaves and fonts, all as expressions on bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import PAGE, be_uint, cell_after, glyph_address
from ..functions.jis import JIS
from ..functions.normalize import KANA_STYLE

#: What an index is, by its number.
INDEX_NAMES = {
    0x00: "text", 0x01: "menu", 0x02: "copyright", 0x10: "image_menu", 0x16: "search_title",
    0x70: "endword_kana", 0x71: "endword_asis", 0x72: "endword_alphabet", 0x80: "keyword", 0x81: "cross",
    0x90: "word_kana", 0x91: "word_asis", 0x92: "word_alphabet", 0xD8: "sound", 0xFF: "multi",
    0xF1: "font_wide_16", 0xF2: "font_narrow_16", 0xF3: "font_wide_24", 0xF4: "font_narrow_24",
    0xF5: "font_wide_30", 0xF6: "font_narrow_30", 0xF7: "font_wide_48", 0xF8: "font_narrow_48",
}
#: Where each style's two bits stand.
STYLE_BITS = {"katakana": 22, "lower": 20, "mark": 18, "long_vowel": 16, "double_consonant": 14, "contracted_sound": 12, "small_vowel": 10, "voiced_consonant": 8, "p_sound": 6}
FIELD_IDS = (0x71, 0x72, 0x91, 0x92, 0xA1, 0xA2, 0xB1, 0xB2)
KANA_IDS = (0x70, 0x90, 0xA1, 0xB1)


MODES = ("failfast", "permissive", "drop")


def checked(rows: DataFrame, error: Column, mode: str) -> DataFrame:
    """rows with ``error``: null, or what is wrong with the row. failfast raises the first, drop leaves such rows out."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "failfast":
        return rows.withColumn("error", F.when(error.isNotNull(), F.raise_error(error)).cast("string"))
    found = rows.withColumn("error", error)
    return found.where("error IS NULL") if mode == "drop" else found


def part(data: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes from a place that counts from 0."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(data, (as_col(at) + 1).cast("int"), as_col(n).cast("int"))


def jis_char(code: Column) -> Column:
    """The character of a two-byte code."""
    index = (F.floor(code / 256) - 0x21) * 94 + code % 256 - 0x21
    return F.substring(F.lit(JIS), (index + 1).cast("int"), F.lit(1))


def jis_text(data: Column) -> Column:
    """A string of two-byte codes; a NUL ends it, and blanks at its end are filling."""
    pairs = F.regexp_extract_all(F.regexp_replace(F.hex(data), "^((?:(?!00)..)*).*$", "$1"), F.lit("(?:20)+$|...."), F.lit(0))
    return F.array_join(F.transform(F.filter(pairs, lambda p: ~F.startswith(p, F.lit("20"))), lambda p: jis_char(F.conv(p, 16, 10).cast("long"))), "")


def latin_text(data: Column) -> Column:
    """A string of ISO 8859-1; a NUL ends it, and blanks at its end are filling."""
    return F.rtrim(F.decode(F.unhex(F.regexp_replace(F.hex(data), "^((?:(?!00)..)*).*$", "$1")), "ISO-8859-1"))


def ascii_name(data: Column) -> Column:
    """A name that ends at the first NUL or blank."""
    hexes = F.regexp_replace(F.hex(data), "^((?:(?!00|20)..)*).*$", "$1")
    return F.decode(F.unhex(hexes), "ISO-8859-1")


def catalog(books: DataFrame, content: str = "content", disc: str = "disc", mode: str = "failfast") -> DataFrame:
    """The subbooks of each catalog: code, title, directory, index_page, error. An EB entry has 40 bytes, an EPWING one 164.

    A catalog that lists none, or that ends within an entry, is an error; permissively it is one row with it. Titles are in the book's
    charset, if books have that column.
    """
    c, epwing = F.col(content), F.col(disc) == "EPWING"
    size, title = F.when(epwing, 164).otherwise(40), F.when(epwing, 80).otherwise(30)
    count = F.least(F.coalesce(be_uint(part(c, 0, 2)), F.lit(0)), F.lit(50))
    whole = F.octet_length(c) >= 16 + count * size
    bad = F.when((count == 0) | ~F.coalesce(whole, F.lit(False)), "catalog: no subbooks, or a truncated entry")
    rows = checked(books, bad, mode)
    fine = F.col("error").isNull()
    each = rows.withColumn("code", F.explode_outer(F.when(fine, F.sequence(F.lit(0), (count - 1).cast("int")))))
    at = F.lit(16) + F.col("code") * size
    name = at + 2 + title
    name_of = (lambda x: F.when(F.col("charset") == 1, latin_text(x)).otherwise(jis_text(x))) if "charset" in books.columns else jis_text
    return each.select(
        *[x for x in books.columns if x != content],
        "code",
        name_of(part(c, at + 2, title)).alias("title"),
        ascii_name(part(c, name, 8)).alias("directory"),
        F.when(fine, F.when(epwing, be_uint(part(c, name + 12, 2))).otherwise(1)).cast("long").alias("index_page"),
        "error",
    )


def catalog_fonts(books: DataFrame, content: str = "content", disc: str = "disc") -> DataFrame:
    """The font files that EPWING catalogs name: code (of the subbook), width, slot (0 to 3, by size), name. Empty slots have no row."""
    c = F.col(content)
    each = books.where(F.col(disc) == "EPWING").withColumn("code", F.explode(F.sequence(F.lit(0), (F.least(be_uint(part(c, 0, 2)), F.lit(50)) - 1).cast("int"))))
    # Where the names of wide and narrow fonts begin, in an entry after its title.
    widths = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.lit(at).alias("at")) for w, at in (("wide", 18), ("narrow", 50))]))
    each = each.withColumn("w", widths).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(3))))
    name = part(c, F.lit(16) + F.col("code") * 164 + 82 + F.col("w.at") + F.col("slot") * 8, 8)
    rows = each.select(*[x for x in books.columns if x != content], "code", "w.width", "slot", be_uint(F.substring(name, 1, 1)).alias("first"), ascii_name(name).alias("name"))
    return rows.where("first BETWEEN 1 AND 127").drop("first")


def style_flags(flags: Column) -> Column:
    """The nine styles of 24 bits; the mark style is the other way round, 0 for deleting."""
    two = lambda n: F.shiftrightunsigned(flags, n).bitwiseAND(F.lit(3))
    fields = [(F.when(two(n) == 0, 2).otherwise(1) if f == "mark" else two(n)).cast("int").alias(f) for f, n in STYLE_BITS.items()]
    return F.struct(*fields)


def applied_style(index_id: Column, flags: Column, available: Column, overall: Column, latin: Column) -> Column:
    """An index's styles: its own flags where they hold, else all folds for kana indexes and letters alone for others."""
    own = ((overall == 0) & (available == 2)) | (overall == 2)
    kana = index_id.isin(*KANA_IDS)
    flagged = style_flags(flags)
    plain = {"lower": 0, "katakana": 1, "mark": 1}
    out = [F.when(own, flagged[f]).when(kana, KANA_STYLE[f]).otherwise(plain.get(f, 1)).cast("int").alias(f) for f in STYLE_BITS]
    space = F.when(latin | index_id.isin(0x72, 0x92), 1).otherwise(2).cast("int").alias("space")
    return F.struct(space, *out)


def index_table(pages: DataFrame, content: str = "bytes", mode: str = "failfast") -> DataFrame:
    """The indexes that a page lists: index_id, name, start_page, end_page, available, overall, flags, error.

    Records without a start or blocks are skipped. Of several with one number the last counts: see latest(). A page that lists none, or
    more than it can hold, is an error; permissively it is one row with it.
    """
    c = F.col(content)
    count = be_uint(part(c, 1, 1))
    overall = be_uint(part(c, 4, 1))
    bad = F.when(F.coalesce((count == 0) | (count >= PAGE // 16), F.lit(True)), "bad index table")
    rows = checked(pages, bad, mode)
    each = rows.withColumn("nth", F.explode_outer(F.when(F.col("error").isNull(), F.sequence(F.lit(0), (count - 1).cast("int")))))
    at = (F.col("nth") + 1) * 16
    start, blocks, index_id = be_uint(part(c, at + 2, 4)), be_uint(part(c, at + 6, 4)), be_uint(part(c, at, 1))
    names = F.create_map(*[F.lit(x) for pair in INDEX_NAMES.items() for x in pair])
    rows = each.select(
        *[x for x in pages.columns if x != content],
        "nth",
        index_id.alias("index_id"),
        F.element_at(names, index_id.cast("int")).alias("name"),
        start.alias("start_page"),
        (start + blocks - 1).alias("end_page"),
        blocks.alias("blocks"),
        be_uint(part(c, at + 10, 1)).alias("available"),
        F.when(overall > 2, 0).otherwise(overall).alias("overall"),
        be_uint(part(c, at + 11, 3)).alias("flags"),
        "error",
    )
    return rows.where("(start_page > 0 AND blocks > 0) OR error IS NOT NULL").drop("blocks")


def multi_table(pages: DataFrame, content: str = "bytes") -> DataFrame:
    """The fields of a multi-search page and each field's records: field_no, label, index_id, start_page, end_page, is_index.

    Fields stand one after the other, each with its number of records, so their places are summed up along the page.
    """
    c = F.col(content)

    def step(acc: Column, n: Column) -> Column:
        count = be_uint(part(c, acc["at"], 1))
        field = F.struct(n.alias("field_no"), acc["at"].alias("at"), count.alias("count"))
        return F.struct((acc["at"] + 32 + count * 16).alias("at"), F.concat(acc["out"], F.array(field)).alias("out"))

    empty = F.array().cast("array<struct<field_no:int,at:bigint,count:bigint>>")
    start = F.struct(F.lit(16).cast("long").alias("at"), empty.alias("out"))
    total = be_uint(part(c, 0, 2)).cast("int")
    fields = pages.where(total > 0).withColumn("f", F.explode(F.aggregate(F.sequence(F.lit(0), total - 1), start, step, lambda acc: acc["out"])))
    each = fields.select("*", "f.*").withColumn("nth", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))))
    at = F.col("at") + 32 + F.col("nth") * 16
    index_id = be_uint(part(c, at, 1))
    return each.select(
        *[x for x in pages.columns if x != content],
        "field_no",
        jis_text(part(c, F.col("at") + 2, 30)).alias("label"),
        "nth",
        index_id.alias("index_id"),
        be_uint(part(c, at + 2, 4)).alias("start_page"),
        (be_uint(part(c, at + 2, 4)) + be_uint(part(c, at + 6, 4)) - 1).alias("end_page"),
        index_id.isin(*FIELD_IDS).alias("is_index"),
        be_uint(part(c, at + 10, 1)).alias("available"),
        be_uint(part(c, at + 11, 3)).alias("flags"),
    )


LEAF = "array<struct<kind:string,key:binary,text:binary,heading:binary>>"


def leaf_entries(pages: DataFrame, layout: str = "word", content: str = "bytes", mode: str = "failfast") -> DataFrame:
    """The entries of index leaves, in their order on the page: slot, kind, key, text_page, text_offset, heading_page, heading_offset, error.

    The first byte says whether entries are grouped (0x10), the second gives the length of fixed keys, 0 for keys
    with their own lengths. In groups 00 is a single entry, 80 a header, C0 a member; in the layouts ``multi`` and
    ``keyword`` headers count members in four bytes and members have no key; a keyword's header has the heading and
    its members the text alone. A page is parsed along itself by one fold; other pages don't matter to it. An entry of
    another kind, or one that overruns the page, is an error, and what follows on its page can't be read: permissively it is a row of kind
    ``error``, and the entries before it are there.
    """
    c = F.col(content)
    length, grouped = be_uint(part(c, 1, 1)), be_uint(part(c, 0, 1)).bitwiseAND(F.lit(0x10)) > 0
    none = F.lit(None).cast("binary")

    def entry(kind: str, key: Column, text: Column, heading: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), text.alias("text"), heading.alias("heading"))

    def step(acc: Column, _n: Column) -> Column:
        at = acc["at"]
        kind, own = be_uint(part(c, at, 1)), be_uint(part(c, at + 1, 1))
        wide = layout in ("multi", "keyword")
        key_at = at + (6 if wide else 4)
        tail = 6 if layout == "keyword" else 0
        fixed = F.struct((at + length + 12).alias("size"), entry("fixed", part(c, at, length), part(c, at + length, 6), part(c, at + length + 6, 6)).alias("e"))
        varied = F.struct((at + 13 + kind).alias("size"), entry("variable", part(c, at + 1, kind), part(c, at + 1 + kind, 6), part(c, at + 7 + kind, 6)).alias("e"))
        single = F.struct((at + 14 + own).alias("size"), entry("single", part(c, at + 2, own), part(c, at + 2 + own, 6), part(c, at + 8 + own, 6)).alias("e"))
        header = F.struct((key_at + own + tail).alias("size"), entry("header", part(c, key_at, own), none, part(c, key_at + own, 6) if tail else none).alias("e"))
        if layout == "keyword":
            member = F.struct((at + 7).alias("size"), entry("member", none, part(c, at + 1, 6), none).alias("e"))
        elif layout == "multi":
            member = F.struct((at + 13).alias("size"), entry("member", none, part(c, at + 1, 6), part(c, at + 7, 6)).alias("e"))
        else:
            member = F.struct((at + 14 + own).alias("size"), entry("member", part(c, at + 2, own), part(c, at + 2 + own, 6), part(c, at + 8 + own, 6)).alias("e"))
        bad = F.struct(F.lit(None).cast("long").alias("size"), entry("error", none, none, none).alias("e"))
        got = F.when(~grouped & (length > 0), fixed).when(~grouped, varied).when(kind == 0, single).when(kind == 0x80, header).when(kind == 0xC0, member).otherwise(bad)
        got = F.when(got["size"] <= F.octet_length(c), got).otherwise(bad)
        after = F.struct(got["size"].cast("long").alias("at"), F.concat(acc["out"], F.array(got["e"])).alias("out"))
        return F.when(at.isNull(), acc).otherwise(after)

    count = be_uint(part(c, 2, 2)).cast("int")
    start = F.struct(F.lit(4).cast("long").alias("at"), F.array().cast(LEAF).alias("out"))
    entries = F.aggregate(F.sequence(F.lit(1), count), start, step, lambda acc: acc["out"])
    rest = [x for x in pages.columns if x != content]
    each = pages.where(count > 0).select(*rest, F.posexplode(entries).alias("slot", "e"))
    each = checked(each, F.when(F.col("e.kind") == "error", "index leaf: an unknown entry, or one that overruns the page"), mode)
    place = lambda f, name: (be_uint(part(F.col(f"e.{f}"), 0, 4)).alias(f"{name}_page"), be_uint(part(F.col(f"e.{f}"), 4, 2)).alias(f"{name}_offset"))
    return each.select(*rest, "slot", "e.kind", "e.key", *place("text", "text"), *place("heading", "heading"), "error")


def glyphs(fonts: DataFrame, content: str = "content") -> DataFrame:
    """The glyphs of fonts (size in bytes of one, content): code and data. Codes start at byte 10, their number is at byte 12."""
    c, size = F.col(content), F.col("size")
    start, count = be_uint(part(c, 10, 2)), be_uint(part(c, 12, 2))
    each = fonts.where(count > 0).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return each.select(*[x for x in fonts.columns if x != content], cell_after(start, F.col("i")).alias("code"), part(c, glyph_address(F.col("i"), size) + PAGE, size).alias("data"))


def subbook(subbooks: DataFrame, which: Column | int) -> DataFrame:
    """Subbooks that a name means: by directory, whatever the case, or by exact title; or by their number."""
    if isinstance(which, int):
        return subbooks.where(F.col("code") == which)
    return subbooks.where((F.lower("directory") == F.lower(which)) | (F.col("title") == which))


def info(subbooks: DataFrame, indexes: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per subbook: title, its search names in order, and its multi-search labels. fields: subbook, field_no, label."""
    names = indexes.groupBy("subbook").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("searches"))
    labels = fields.where("label <> ''").groupBy("subbook").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_no", "label"))), lambda x: x["label"]), " / ").alias("labels"))
    return subbooks.join(names, "subbook", "left").join(labels, "subbook", "left")
