"""Queries of the disc formats. Bytes are made of the driver's tables and decoded again, so SQL over the tables is the answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import ASCII_WIDE
from ..operators import decode as T1
from ..operators import entries as E
from ..operators.private_chars import latest
from ..operators.runs import running_total
from ..sources import discs as D
from ..sources import files as S
from ..sources import textfiles as T
from ..sources.collection import Collection
from .corpora import sql_map
from .registry import query, spread, table


def be(x: Column, n: int) -> Column:
    return F.lpad(F.hex(x.cast("long")), 2 * n, "0")


def jis(text: Column) -> Column:
    """ASCII letters, digits and blanks as two-byte codes, in hexadecimal."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c == " ", "2121").otherwise(F.concat(F.lit("23"), F.hex(F.ascii(c))))), "")


def joined(rows: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
    """The values of each group, in order, as one string."""
    each = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("x"), F.count(F.lit(1)).alias("n"))
    return each.withColumn("hex", F.array_join(F.transform("x", lambda v: v["v"]), "")).drop("x")


def page_stream(rows: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """by, page (from 0), hex: the values of each group one after the other, cut into pages; ``hex`` holds no more than a page.

    A value's place is the running length before it, in two levels, and each page takes its pieces of the values, so that no row holds a
    group's stream. order: a unique number from 0.
    """
    placed = running_total(rows.select(by, order, value.alias("v")), [by], order, F.length("v").cast("long"), "at")
    each = placed.where("v <> ''").withColumn("page", F.explode(F.expr("sequence(at DIV 4096, (at + length(v) - 1) DIV 4096)")))
    begin = F.greatest(F.col("page") * 4096 - F.col("at"), F.lit(0))
    end = F.least((F.col("page") + 1) * 4096 - F.col("at"), F.length("v").cast("long"))
    pieces = each.withColumn("piece", F.substring("v", (begin + 1).cast("int"), (end - begin).cast("int")))
    return joined(pieces, [by, "page"], order, F.col("piece")).select(by, "page", "hex")


def numbered(rows: DataFrame, by: str, order: str, name: str = "nth") -> DataFrame:
    """rows with their number in their group, from 0, in two levels."""
    return running_total(rows, [by], order, F.lit(1), name).withColumn(name, F.col(name).cast("long"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.withColumns({"leaf": F.expr("p_partkey DIV 40"), "word": F.split("p_name", " ")[0], "nth": F.expr("cast(p_partkey % 40 AS int)")})


PLACES = "p_partkey + 1 AS text_page, p_size::BIGINT AS text_offset, p_partkey + 7 AS heading_page, (p_size + 1)::BIGINT AS heading_offset"


def places() -> Column:
    return F.concat(be(F.col("p_partkey") + 1, 4), be(F.col("p_size"), 2), be(F.col("p_partkey") + 7, 4), be(F.col("p_size") + 1, 2))


def leaves(rows: DataFrame, head: str, value: Column) -> DataFrame:
    pages = joined(rows, ["leaf"], "p_partkey", value)
    return pages.select("leaf", F.unhex(F.concat(F.lit(head), be(F.col("n"), 2), F.col("hex"))).alias("bytes"))


def keys(found: DataFrame) -> DataFrame:
    return found.withColumn("key", F.hex("key")).drop("error")


JIS_SQL = "list_aggregate(list_transform(string_split({x}, ''), lambda c: CASE c WHEN ' ' THEN '2121' ELSE '23' || hex(c) END), 'string_agg', '')"
WORD_KEY = JIS_SQL.replace("{x}", "string_split(p_name, ' ')[1]")
SLOT = "p_partkey // 40 AS leaf, (p_partkey % 40)::INT AS slot"


@query(f"SELECT {SLOT}, 'fixed' AS kind, {JIS_SQL.replace('{x}', 'left(p_name, 2)')} AS key, {PLACES} FROM part")
def src_leaf_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(D.leaf_entries(leaves(parts(spark, sf_dir), "8004", F.concat(jis(F.substring("p_name", 1, 2)), places()))))


@query(f"SELECT {SLOT}, 'variable' AS kind, {WORD_KEY} AS key, {PLACES} FROM part")
def src_leaf_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = jis(F.col("word"))
    return keys(D.leaf_entries(leaves(parts(spark, sf_dir), "8000", F.concat(be(F.length(key) / 2, 1), key, places()))))


def _grouped(layout: str) -> Column:
    """Every fifth entry is a header, every seventh a single one, the others members."""
    key = jis(F.col("word"))
    n = be(F.length(key) / 2, 1)
    text, heading = F.concat(be(F.col("p_partkey") + 1, 4), be(F.col("p_size"), 2)), F.concat(be(F.col("p_partkey") + 7, 4), be(F.col("p_size") + 1, 2))
    header = F.concat(F.lit("80"), n, be(F.lit(4), 2 if layout == "word" else 4), key, heading if layout == "keyword" else F.lit(""))
    member = {"word": F.concat(F.lit("C0"), n, key, text, heading), "multi": F.concat(F.lit("C0"), text, heading), "keyword": F.concat(F.lit("C0"), text)}[layout]
    single = F.concat(F.lit("00"), n, key, text, heading)
    return F.when(F.col("nth") % 5 == 0, header).when(F.col("nth") % 7 == 0, single).otherwise(member)


def _grouped_sql(layout: str) -> str:
    kind = "CASE WHEN p_partkey % 40 % 5 = 0 THEN 'header' WHEN p_partkey % 40 % 7 = 0 THEN 'single' ELSE 'member' END"
    key = f"CASE WHEN kind <> 'member' OR {layout == 'word'} THEN {WORD_KEY} END"
    heading = {"word": "kind <> 'header'", "multi": "kind <> 'header'", "keyword": "kind <> 'member'"}[layout]
    return f"SELECT {SLOT}, kind, {key} AS key, CASE WHEN kind <> 'header' THEN p_partkey + 1 END AS text_page, CASE WHEN kind <> 'header' THEN p_size::BIGINT END AS text_offset, CASE WHEN {heading} THEN p_partkey + 7 END AS heading_page, CASE WHEN {heading} THEN (p_size + 1)::BIGINT END AS heading_offset FROM (SELECT *, {kind} AS kind FROM part)"


for _layout, _name in (("word", "src_leaf_group"), ("multi", "src_leaf_multi"), ("keyword", "src_leaf_keyword")):

    def _run(spark: SparkSession, sf_dir: str, layout: str = _layout) -> DataFrame:
        return keys(D.leaf_entries(leaves(parts(spark, sf_dir), "9000", _grouped(layout)), layout))

    query(_grouped_sql(_layout), _name)(_run)


def short(key: Column) -> Column:
    """A part's number to base 36: names on a disc have eight bytes, and a longer one would be cut there."""
    return F.conv(key.cast("string"), 10, 36)


def spelt(digits: Column) -> Column:
    return F.conv(digits, 36, 10)


@query("SELECT p_partkey // 40 AS book, (p_partkey % 40)::INT AS code, " + sql_map("p_name", ASCII_WIDE) + " AS title, 'DIR' || p_partkey AS directory, (p_partkey % 100 + 2)::BIGINT AS index_page FROM part")
def src_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EPWING catalogs of 40 subbooks. On the disc a directory is D and the part's number in up to seven digits to base 36."""
    title = F.rpad(jis(F.col("p_name")), 160, "0")
    directory = F.rpad(F.hex(F.concat(F.lit("D"), short(F.col("p_partkey")))), 16, "20")
    entry = F.concat(F.lit("0000"), title, directory, F.lit("00000000"), be(F.col("p_partkey") % 100 + 2, 2))
    books = joined(parts(spark, sf_dir), ["leaf"], "p_partkey", F.rpad(entry, 328, "0"))
    books = books.select(F.col("leaf").alias("book"), F.lit("EPWING").alias("disc"), F.unhex(F.concat(be(F.col("n"), 2), F.lit("00" * 14), F.col("hex"))).alias("content"))
    return D.catalog(books).drop("disc", "error").withColumn("directory", F.concat(F.lit("DIR"), spelt(F.substring("directory", 2, 7))))


@query("SELECT p_partkey // 40 AS book, (p_partkey % 40)::INT AS code, width, slot, left(width, 1) || p_partkey || slot AS name FROM part, (SELECT unnest(['wide', 'narrow']) AS width), (SELECT unnest([0, 1, 2, 3])::INT AS slot) WHERE slot <> p_partkey % 5")
def src_catalog_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The font names of EPWING catalogs; most subbooks lack one size. On the disc a name has the part's number to base 36."""
    slot = lambda w, i: F.when(F.col("p_partkey") % 5 == i, "0" * 16).otherwise(F.rpad(F.hex(F.concat(F.lit(w), short(F.col("p_partkey")), F.lit(str(i)))), 16, "0"))
    fonts = F.concat(*[slot(w, i) for w in "wn" for i in range(4)])
    entry = F.concat(F.lit("00" * 100), fonts)
    books = joined(parts(spark, sf_dir), ["leaf"], "p_partkey", entry)
    books = books.select(F.col("leaf").alias("book"), F.lit("EPWING").alias("disc"), F.unhex(F.concat(be(F.col("n"), 2), F.lit("00" * 14), F.col("hex"))).alias("content"))
    found = D.catalog_fonts(books).drop("disc")
    return found.withColumn("name", F.expr("concat(left(name, 1), conv(substring(name, 2, length(name) - 2), 36, 10), right(name, 1))"))


DAMAGED = "leaf % 9 = 0"


@query(
    f"""SELECT leaf, slot, CASE WHEN slot < 5 OR NOT ({DAMAGED}) THEN 'fixed' ELSE 'error' END AS kind, CASE WHEN slot < 5 OR NOT ({DAMAGED}) THEN key END AS key
        FROM (SELECT {SLOT}, min(p_partkey % 40) OVER (PARTITION BY p_partkey // 40)::INT AS first, {JIS_SQL.replace('{x}', 'left(p_name, 2)')} AS key FROM part) WHERE slot - first <= 5 OR NOT ({DAMAGED})""".replace("slot < 5", "slot - first < 5")
)
def src_leaf_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth leaf ends after its fifth entry: five entries, then a row for the error; all other leaves are whole."""
    whole = leaves(parts(spark, sf_dir), "8004", F.concat(jis(F.substring("p_name", 1, 2)), places()))
    cut = whole.withColumn("bytes", F.when(F.expr(DAMAGED), F.substring("bytes", F.lit(1), F.lit(4 + 5 * 16 + 3))).otherwise(F.col("bytes")))
    first = parts(spark, sf_dir).groupBy("leaf").agg(F.min("nth").alias("first"))
    found = D.leaf_entries(cut, mode="permissive").join(first, "leaf")
    return found.select("leaf", (F.col("slot") + F.col("first")).alias("slot"), "kind", F.hex("key").alias("key"))


@query(f"SELECT leaf, count(*) AS n FROM (SELECT {SLOT} FROM part) GROUP BY leaf, slot // 20 HAVING NOT ({DAMAGED} AND slot // 20 = 1)".replace("SELECT leaf, count(*) AS n", "SELECT leaf, slot // 20 AS half, count(*) AS n"))
def src_catalog_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs of 20 subbooks, some of them cut: those are left out."""
    p = parts(spark, sf_dir).withColumn("half", F.floor(F.col("nth") / 20).cast("int"))
    entry = F.rpad(F.concat(F.lit("0000"), jis(F.lit("x"))), 328, "0")
    books = joined(p, ["leaf", "half"], "p_partkey", entry)
    bad = F.expr(DAMAGED) & (F.col("half") == 1)
    content = F.concat(be(F.col("n"), 2), F.lit("00" * 14), F.col("hex"))
    books = books.select("leaf", "half", F.lit("EPWING").alias("disc"), F.unhex(F.when(bad, F.substring(content, F.lit(1), F.length("hex"))).otherwise(content)).alias("content"))
    return D.catalog(books, mode="drop").groupBy("leaf", "half").agg(F.count(F.lit(1)).alias("n"))


IDS = list(D.INDEX_NAMES)


@query(
    f"""SELECT book, nth, index_id, ({[D.INDEX_NAMES[i] for i in IDS]})[index_id_at + 1] AS name, p_partkey + 1 AS start_page, p_partkey + p_size AS end_page, p_partkey % 3 AS available, 2::BIGINT AS overall, p_partkey * 3000 % 16777216 AS flags
        FROM (SELECT *, p_partkey // 40 AS book, (p_partkey % 40)::INT AS nth, (p_partkey % {len(IDS)})::INT AS index_id_at, ({IDS})[(p_partkey % {len(IDS)})::INT + 1]::BIGINT AS index_id FROM part)"""
)
def src_index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    index_id = F.element_at(F.array(*map(F.lit, IDS)), (F.col("p_partkey") % len(IDS) + 1).cast("int"))
    record = F.concat(be(index_id, 1), F.lit("00"), be(F.col("p_partkey") + 1, 4), be(F.col("p_size"), 4), be(F.col("p_partkey") % 3, 1), be(F.col("p_partkey") * 3000 % (1 << 24), 3), F.lit("0000"))
    pages = joined(parts(spark, sf_dir), ["leaf"], "p_partkey", record)
    pages = pages.select(F.col("leaf").alias("book"), F.unhex(F.concat(F.lit("00"), be(F.col("n"), 1), F.lit("000002" + "00" * 11), F.col("hex"))).alias("bytes"))
    return D.index_table(pages).drop("error")


@query(
    f"""SELECT p_partkey // 40 AS book, (p_partkey % 40)::INT AS field_no, {sql_map("string_split(p_name, ' ')[1]", ASCII_WIDE)} AS label, k AS nth, ([145, 1])[k + 1]::BIGINT AS index_id, p_partkey + k + 1 AS start_page, p_partkey + k + 1 AS end_page, k = 0 AS is_index
        FROM part, (SELECT unnest([0, 1])::INT AS k) WHERE k <= p_size % 2"""
)
def src_multi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with an index, and for odd sizes a menu of candidates."""
    record = lambda i, k: F.concat(F.lit(i), F.lit("00"), be(F.col("p_partkey") + 1 + k, 4), be(F.lit(1), 4), F.lit("01" + "00" * 5))
    odd = F.col("p_size") % 2 == 1
    field = F.concat(F.when(odd, "02").otherwise("01"), F.lit("00"), F.rpad(jis(F.col("word")), 60, "0"), record("91", 0), F.when(odd, record("01", 1)).otherwise(""))
    pages = joined(parts(spark, sf_dir), ["leaf"], "p_partkey", field)
    return D.multi_table(pages.select(F.col("leaf").alias("book"), F.unhex(F.concat(be(F.col("n"), 2), F.lit("00" * 14), F.col("hex"))).alias("bytes"))).drop("available", "flags")


def _two(n: int) -> str:
    return f"(f >> {n}) & 3"


STYLES_SQL = ", ".join(f"(CASE WHEN {_two(n)} = 0 THEN 2 ELSE 1 END)::INT AS {k}" if k == "mark" else f"({_two(n)})::INT AS {k}" for k, n in D.STYLE_BITS.items())


@query(f"SELECT p_partkey, {STYLES_SQL} FROM (SELECT p_partkey, p_partkey * 7919 % 16777216 AS f FROM part)")
def src_style_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", D.style_flags(F.col("p_partkey") * 7919 % (1 << 24)).alias("s"))
    return p.select("p_partkey", "s.*")


@query(
    """SELECT p_partkey, (CASE WHEN latin OR id IN (114, 146) THEN 1 ELSE 2 END)::INT AS space, (CASE WHEN own THEN (f >> 22) & 3 WHEN kana THEN 0 ELSE 1 END)::INT AS katakana,
        (CASE WHEN own THEN (f >> 20) & 3 ELSE 0 END)::INT AS lower, (CASE WHEN own THEN CASE WHEN (f >> 18) & 3 = 0 THEN 2 ELSE 1 END WHEN kana THEN 2 ELSE 1 END)::INT AS mark, (CASE WHEN own THEN (f >> 6) & 3 WHEN kana THEN 0 ELSE 1 END)::INT AS p_sound
        FROM (SELECT *, (overall = 0 AND available = 2) OR overall = 2 AS own, id IN (112, 144, 161, 177) AS kana FROM (SELECT p_partkey, p_partkey * 7919 % 16777216 AS f, p_size % 3 AS overall, p_partkey % 3 AS available, ([112, 145, 146, 161])[(p_partkey % 4)::INT + 1] AS id, p_brand = 'Brand#1' AS latin FROM part))"""
)
def src_style_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    index_id = F.element_at(F.array(*map(F.lit, (0x70, 0x91, 0x92, 0xA1))), (F.col("p_partkey") % 4 + 1).cast("int"))
    style = D.applied_style(index_id, F.col("p_partkey") * 7919 % (1 << 24), F.col("p_partkey") % 3, F.col("p_size") % 3, F.col("p_brand") == "Brand#1")
    return table(spark, sf_dir, "part").select("p_partkey", style.alias("s")).select("p_partkey", "s.space", "s.katakana", "s.lower", "s.mark", "s.p_sound")


@query("SELECT p_partkey // 40 AS font, (41249 + p_partkey % 40)::BIGINT AS code, repeat(lpad(hex(p_partkey % 256), 2, '0'), 48) AS data FROM part")
def src_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts of 40 glyphs of 48 bytes: 21 in a chunk of 1024."""
    p = parts(spark, sf_dir)
    data = F.concat(F.repeat(be(F.col("p_partkey") % 256, 1), 48), F.when(F.col("nth") % 21 == 20, "00" * 16).otherwise(""))
    fonts = joined(p, ["leaf"], "p_partkey", data)
    head = F.rpad(F.concat(F.lit("00" * 10), be(F.lit(0xA121), 2), be(F.col("n"), 2)), 4096, "0")
    fonts = fonts.select(F.col("leaf").alias("font"), F.lit(48).alias("size"), F.unhex(F.concat(head, F.col("hex"))).alias("content"))
    return D.glyphs(fonts).select("font", "code", F.hex("data").alias("data"))


@query("SELECT doc_id, unnest(range(1, (strlen(text) + 2047) // 2048 + 1))::INT AS page, md5(text) AS file FROM documents WHERE text <> ''")
def src_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files of pages; put together again they are the file."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    pages = S.paged(d)
    whole = pages.groupBy("doc_id").agg(F.md5(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.hex("bytes").alias("h")))), lambda x: x["h"]), ""))).alias("file"))
    return pages.select("doc_id", "page").join(whole, "doc_id")


@query("SELECT doc_id, unnest(range(0, (strlen(text) + 4095) // 4096))::INT AS slice, md5(text) AS file FROM documents WHERE text <> ''")
def src_ebzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as compressed files of level 1, every other slice stored as it is where it is whole; read back and put together."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        def one(data: bytes) -> bytes:
            cuts = [data[i : i + 4096].ljust(4096, b"\0") for i in range(0, len(data), 4096)]
            slices = [c if i % 2 else zlib.compress(c) for i, c in enumerate(cuts)]
            width = 2 if len(data) < 1 << 16 else 3
            at, offsets = 22 + width * (len(slices) + 1), []
            for s in [*slices, b""]:
                offsets.append(at.to_bytes(width, "big"))
                at += len(s)
            return b"EBZip\x11\0\0\0" + len(data).to_bytes(5, "big") + bytes(8) + b"".join(offsets) + b"".join(slices)

        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([one(t.as_py()) for t in part.column(1)], pa.binary())], names=["doc_id", "content"])

    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.col("text").cast("binary").alias("text"))
    slices = S.inflated(S.ebzip_slices(d.mapInArrow(packed, "doc_id long, content binary"))).select("doc_id", "slice", "bytes")
    # A file's slices are numbered where they meet: with a join of the two, each text would be packed twice.
    each = slices.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("slice", F.hex("bytes").alias("h")))).alias("x"))
    whole = each.select("doc_id", F.transform("x", lambda x: x["slice"]).alias("slices"), F.md5(F.unhex(F.array_join(F.transform("x", lambda x: x["h"]), ""))).alias("file"))
    return whole.select("doc_id", F.explode("slices").alias("slice"), "file")


LISTING = "(SELECT p_partkey // 3 AS directory, CASE p_partkey % 3 WHEN 0 THEN 'HONMON;1' WHEN 1 THEN 'Honmon.ebz' ELSE 'CATALOGS.' END AS name FROM part)"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select(F.expr("p_partkey DIV 3").alias("directory"), F.when(n == 0, "HONMON;1").when(n == 1, "Honmon.ebz").otherwise("CATALOGS.").alias("name"))


@query(f"SELECT directory, coalesce(max(name) FILTER (name = 'HONMON;1'), max(name)) AS name, max(name) FILTER (name = 'HONMON;1') IS NULL AS packed FROM {LISTING} WHERE name <> 'CATALOGS.' GROUP BY directory")
def src_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chosen_file(listing(spark, sf_dir), F.lit("honmon"))


@query(f"SELECT directory, 'EPWING' AS disc FROM {LISTING} WHERE name = 'CATALOGS.' GROUP BY directory")
def src_list_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.books(listing(spark, sf_dir))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE lower(p_brand) = 'brand#7' OR p_name = 'brand#7'")
def src_subbook_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("directory"))
    found = D.subbook(p, F.lit("bRAND#7"))
    return found.select("p_partkey", F.col("title").alias("p_name"), F.col("directory").alias("p_brand"))


@query("SELECT p_brand AS subbook, string_agg(DISTINCT lower(p_type), ', ' ORDER BY lower(p_type)) AS searches, (SELECT string_agg(p_name, ' / ' ORDER BY p_partkey) FROM part q WHERE q.p_brand = part.p_brand AND q.p_size > 45) AS labels FROM part GROUP BY p_brand")
def src_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "subbook")
    fields = p.select("subbook", F.col("p_partkey").alias("field_no"), F.when(F.col("p_size") > 45, F.col("p_name")).otherwise("").alias("label"))
    return D.info(p.select("subbook").distinct(), p.select("subbook", F.lower("p_type").alias("name")), fields)


def text_lines(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """A file of 40 lines for every 40 parts."""
    p = parts(spark, sf_dir)
    return p.select(F.col("leaf").alias("path"), F.col("nth").alias("line_no"), line.alias("line"))


@query(
    """SELECT p_partkey // 40 AS path, (p_partkey % 40)::INT AS line_no, CASE WHEN k < 4 THEN k = 1 END AS narrow, CASE WHEN k < 4 THEN 41249 + p_size END AS code, CASE k WHEN 1 THEN p_name WHEN 2 THEN '' WHEN 3 THEN '# ' || p_name END AS replacement, CASE WHEN k = 4 THEN 'line ' || (p_partkey % 40 + 1) END AS error
        FROM (SELECT *, p_partkey % 5 AS k FROM part) WHERE k > 0"""
)
def src_gaiji_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping files with comments, empty replacements, replacements that begin with #, and malformed lines."""
    k, code = F.col("p_partkey") % 5, F.lower(F.hex(F.col("p_size") + 41249))
    line = F.when(k == 0, F.concat(F.lit("  # "), "p_name")).when(k == 1, F.concat(F.lit("h"), code, F.lit("\t"), "p_name")).when(k == 2, F.concat(F.lit("z"), code)).when(k == 3, F.concat(F.lit("z"), code, F.lit("  # "), "p_name")).otherwise(F.concat(F.lit("x"), code, F.lit(" y")))
    return T.gaiji_map(text_lines(spark, sf_dir, line))


@query("SELECT 'dict' || p_partkey AS name, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_partkey) - 1 AS rank FROM part WHERE p_size % 3 > 0")
def src_order_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_size") % 3, F.concat(F.lit("dict"), F.col("p_partkey").cast("string"))
    line = F.when(k == 0, F.concat(F.lit(" # "), name)).when(k == 1, F.concat(F.lit("/books/"), name, F.lit("/ # the best"))).otherwise(name)
    return T.order_file(text_lines(spark, sf_dir, line))


@query(
    """WITH l AS (SELECT p_partkey // 40 AS path, (p_partkey % 40)::INT AS line_no, p_size, p_name, p_partkey % 20 AS k FROM part)
        SELECT path, line_no, CASE k WHEN 0 THEN 'stop' WHEN 9 THEN 'error' WHEN 1 THEN 'charset' WHEN 18 THEN 'error' ELSE 'char' END AS kind, CASE WHEN k BETWEEN 3 AND 8 THEN true WHEN k BETWEEN 11 AND 16 THEN false END AS narrow,
               CASE WHEN k = 0 THEN 7945 WHEN k BETWEEN 3 AND 8 OR k BETWEEN 11 AND 16 THEN 41249 + p_size END AS code, CASE WHEN k = 0 THEN 1 END AS argument, CASE WHEN k = 1 THEN 'JISX0208' WHEN k BETWEEN 3 AND 8 OR k BETWEEN 11 AND 16 THEN p_name || ' #' END AS text,
               CASE k WHEN 9 THEN 'unknown directive' WHEN 18 THEN 'character outside a block' END AS error
        FROM l WHERE k NOT IN (2, 10, 17, 19)"""
)
def src_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appendices with a stop code, both blocks, an unknown directive and a character outside the blocks."""
    k, code = F.col("p_partkey") % 20, F.lower(F.hex(F.col("p_size") + 41249))
    char = F.concat(F.lit("0x"), code, F.lit(" "), "p_name", F.lit(" #"))
    line = (
        F.when(k == 0, "stop-code 0x1f09 0x0001").when(k == 1, "character-code JISX0208").when(k == 2, "begin narrow").when(k == 9, "nonsense").when(k == 10, "begin wide")
        .when(k == 17, "end").when(k == 19, "# comment").otherwise(char)
    )
    return T.appendix(text_lines(spark, sf_dir, line))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as bytes: a keyword as headword, a subscript, a private character, a line end, a skipped region, a reference, a menu line, then the next entry."""
    p = spread(parts(spark, sf_dir), "p_partkey")
    target = F.concat(F.lpad((F.col("p_partkey") + 1).cast("string"), 8, "0"), F.lpad(F.col("p_size").cast("string"), 4, "0"))
    menu = F.when(F.col("p_size") % 2 == 0, target).otherwise("0" * 12)
    body = F.concat(
        F.lit("1F0900011F410100"), jis(F.col("p_name")), F.lit("1F61"), F.lit("1F06"), jis(F.col("p_size").cast("string")), F.lit("1F07"),
        F.lit("1F04A1231F05B124"), F.lit("1F0A"), F.lit("1F35"), jis(F.lit("hidden")), F.lit("1F55"), F.lit("00"),
        F.lit("1F420000"), jis(F.col("word")), F.lit("1F62"), target, F.lit("1F43"), jis(F.lit("menu")), F.lit("1F63"), menu,
        F.lit("1F0900011F410100"), jis(F.lit("next")),
    )
    return p.select(F.col("p_partkey").alias("entry"), F.unhex(body).alias("bytes"))


def plain_texts(decoded: DataFrame) -> DataFrame:
    return decoded.drop("spans", "error")


WIDE_NAME = sql_map("p_name", ASCII_WIDE)
WIDE_WORD = sql_map("string_split(p_name, ' ')[1]", ASCII_WIDE)
HEAD_TEXT = f"{WIDE_NAME} || {sql_map('p_size::VARCHAR', ASCII_WIDE)} || '<gaiji=ha123><gaiji=zb124>'"
FIRST = "8 + 2 * length(p_name) + 2 + 2 + 2 * length(p_size::VARCHAR) + 2 + 8 + 2"


@query(f"SELECT p_partkey AS entry, {HEAD_TEXT} || chr(10) || {WIDE_WORD} || 'ｍｅｎｕ' AS text, 'soft' AS stop, ({FIRST} + 16 + 1 + 4 + 2 * length(string_split(p_name, ' ')[1]) + 8 + 2 + 8 + 8 + 4 + 4)::BIGINT AS next, 'ha123,zb124' AS unknown FROM part")
def text_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword escape that opened the entry ends it where it comes again."""
    return plain_texts(T1.decoded(streams(spark, sf_dir)))


@query(f"SELECT p_partkey AS entry, {HEAD_TEXT} AS text, 'soft' AS stop, ({FIRST})::BIGINT AS next, 'ha123,zb124' AS unknown FROM part")
def text_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In headings a line end is the end."""
    return plain_texts(T1.decoded(streams(spark, sf_dir), heading=True))


@query(f"SELECT p_partkey AS entry, (length({HEAD_TEXT}) + 1)::INT AS start, (length({HEAD_TEXT}) + 1 + length(string_split(p_name, ' ')[1]))::INT AS \"end\", p_partkey + 1 AS page, p_size AS \"offset\" FROM part")
def text_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spans(E.events(E.tokens(streams(spark, sf_dir))), "42", "62")


@query(f"SELECT p_partkey AS entry, (length({HEAD_TEXT}) + 1 + length(string_split(p_name, ' ')[1]))::INT AS start, (length({HEAD_TEXT}) + 5 + length(string_split(p_name, ' ')[1]))::INT AS \"end\", CASE WHEN p_size % 2 = 0 THEN p_partkey + 1 END AS page, CASE WHEN p_size % 2 = 0 THEN p_size END AS \"offset\" FROM part")
def text_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menu lines; a target of zeros is none."""
    return E.spans(E.events(E.tokens(streams(spark, sf_dir))), "43", "63")


@query(f"SELECT p_partkey AS entry, {HEAD_TEXT} || chr(10) || {WIDE_WORD} || 'ｍｅｎｕ' AS text, 'soft' AS stop, ({FIRST} + 16 + 1 + 4 + 2 * length(string_split(p_name, ' ')[1]) + 8 + 2 + 8 + 8 + 4 + 4)::BIGINT AS next, 'ha123,zb124' AS unknown FROM part")
def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same entries from rows of events, which any rendering can be made of."""
    return E.entry_texts(E.events(E.tokens(streams(spark, sf_dir))))


def styled_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with each kind of span, some in others: an indent, emphasis round a superscript, a decoration, a region without line ends."""
    p = spread(parts(spark, sf_dir), "p_partkey")
    size = jis(F.col("p_size").cast("string"))
    body = F.concat(
        F.lit("1F09"), be(F.col("p_size"), 2), F.lit("1F12"), jis(F.col("word")), F.lit("1F0E"), size, F.lit("1F0F1F13"),
        F.lit("1FE0"), be(F.col("p_size") + 1, 2), jis(F.lit("deco")), F.lit("1FE1"), F.lit("1F10"), jis(F.lit("a b")), F.lit("1F111F03"),
    )
    return p.select(F.col("p_partkey").alias("entry"), F.unhex(body).alias("bytes"))


SPAN_SQL = "p_partkey AS entry, '{kind}' AS kind, ({start})::INT AS start, ({end})::INT AS \"end\", {value} AS value FROM part"
W, N = "length(string_split(p_name, ' ')[1])", "length(p_size::VARCHAR)"


@query(
    " UNION ALL ".join(
        "SELECT " + SPAN_SQL.format(kind=k, start=a, end=b, value=v)
        for k, a, b, v in (
            ("indent", "0", "0", "p_size"),
            ("superscript", W, f"{W} + {N}", "NULL::INT"),
            ("emphasis", "0", f"{W} + {N}", "NULL::INT"),
            ("decoration", f"{W} + {N}", f"{W} + {N} + 4", "p_size + 1"),
            ("no_newline", f"{W} + {N} + 4", f"{W} + {N} + 7", "NULL::INT"),
        )
    )
)
def text_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superscript, emphasis, decoration, indent and no-newline as spans of the text."""
    found = T1.decoded(styled_streams(spark, sf_dir)).select("entry", F.explode("spans").alias("s"))
    return found.select("entry", "s.kind", "s.start", "s.end", "s.value")


@query("SELECT p_partkey AS entry, p_name || '(' || p_type || CASE WHEN p_size % 2 = 0 THEN '₁₂' ELSE '(x1)' END || ')y' AS text, 'hard' AS stop FROM part")
def text_nested_subscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscripts in subscripts: digits become subscript digits, all else stands in parentheses."""
    plain_hex = lambda c: F.hex(F.encode(c, "ISO-8859-1"))
    inner = F.when(F.col("p_size") % 2 == 0, plain_hex(F.lit("12"))).otherwise(plain_hex(F.lit("x1")))
    body = F.concat(plain_hex(F.col("p_name")), F.lit("1F06"), plain_hex(F.col("p_type")), F.lit("1F06"), inner, F.lit("1F071F071F061F07"), plain_hex(F.lit("y")), F.lit("1F03"))
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("entry"), F.unhex(body).alias("bytes"))
    return T1.decoded(rows, charset=T1.LATIN).select("entry", "text", "stop")


BROKEN_SQL = f"""SELECT p_partkey AS entry, {WIDE_NAME} AS text, CASE p_size % 3 WHEN 1 THEN 'an escape is cut at ' || 2 * length(p_name) WHEN 2 THEN 'a character is cut at ' || 2 * length(p_name) END AS error FROM part"""


@query(BROKEN_SQL)
def text_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third entry breaks off within an escape, every third within a character: what was read comes with the error."""
    end = F.when(F.col("p_size") % 3 == 1, "1F4200").when(F.col("p_size") % 3 == 2, "23").otherwise("1F03")
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("entry"), F.unhex(F.concat(jis(F.col("p_name")), end)).alias("bytes"))
    return T1.decoded(rows).select("entry", "text", "error")


@query("SELECT p_partkey AS entry, CASE WHEN p_size % 4 = 0 THEN p_name ELSE " + WIDE_NAME + " END || CASE p_size % 4 WHEN 0 THEN 'xyz' WHEN 1 THEN 'ａ' ELSE '' END AS text FROM part")
def text_mixed_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of Latin, EB, EPWING and GB books in one table: the optional argument is left out where an older disc leaves it out."""
    k = F.col("p_size") % 4
    body = F.when(k == 0, F.concat(F.hex(F.encode("p_name", "ISO-8859-1")), F.lit("78797A1F03"))).when(k == 1, F.concat(jis(F.col("p_name")), F.lit("1F1A23611F03"))).when(k == 2, F.concat(jis(F.col("p_name")), F.lit("1F1A23611F03"))).otherwise(F.concat(jis(F.col("p_name")), F.lit("1F1C1F03")))
    charset = F.when(k == 0, T1.LATIN).when(k == 3, T1.GB_CODES).otherwise(T1.JIS_CODES)
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("entry"), F.unhex(body).alias("bytes"), charset.alias("charset"), (k != 1).alias("epwing"))
    return T1.decoded(rows, F.col("charset"), F.col("epwing")).select("entry", "text")


@query("SELECT p_partkey AS entry, p_name || 'é' || chr(10) || p_type || '<gaiji=h8041>' AS text, 'hard' AS stop, (length(p_name) + length(p_type) + 7)::BIGINT AS next, 'h8041' AS unknown FROM part")
def text_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a Latin book: a byte a character, and private characters of two."""
    ascii_hex = lambda c: F.hex(F.encode(F.col(c), "ISO-8859-1"))
    body = F.concat(F.lit("1F02"), ascii_hex("p_name"), F.lit("E91F0A"), ascii_hex("p_type"), F.lit("80411F03"), ascii_hex("p_name"))
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("entry"), F.unhex(body).alias("bytes"))
    return plain_texts(T1.decoded(rows, charset=T1.LATIN))


@query("SELECT p_partkey AS entry, CASE WHEN p_size % 2 = 0 THEN '啊' ELSE '座' END || 'ａ' AS text, CASE WHEN p_size % 3 = 0 THEN 'none' ELSE 'hard' END AS stop, CASE WHEN p_size % 3 = 0 THEN 12 ELSE 4 END::BIGINT AS next, '' AS unknown FROM part")
def text_gb2312(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters with the high bit in the second byte alone; entries that are cut where no escape ends them end by nothing."""
    char = F.when(F.col("p_size") % 2 == 0, "30A1").otherwise("57F9")
    body = F.concat(char, F.lit("2361"), F.when(F.col("p_size") % 3 == 0, "1F06" * 4).otherwise("1F03"))
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("entry"), F.unhex(body).alias("bytes"))
    return plain_texts(T1.decoded(rows, charset=T1.GB_CODES, most=12))


@query("SELECT p_brand, arg_max(p_name, p_partkey) AS p_name FROM part GROUP BY p_brand")
def src_index_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several records with one number the last counts."""
    return latest(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey").select("p_brand", "p_name")


APPENDICES = """(SELECT p_partkey, 1 AS near, '/c/appendix' AS directory FROM part WHERE p_partkey % 4 = 0
    UNION ALL SELECT p_partkey, 2, '/c/appendix/B' || p_size FROM part WHERE p_partkey % 5 = 0
    UNION ALL SELECT p_partkey, 3, '/c/appendix/x' || p_size FROM part WHERE p_partkey % 3 = 0
    UNION ALL SELECT p_partkey, 3, '/c/appendix/y' || p_size FROM part WHERE p_partkey % 6 = 0
    UNION ALL SELECT p_partkey, 4, '/c/appendix/y/z' FROM part WHERE p_partkey % 7 = 0)"""


@query(
    f"""WITH a AS (SELECT p_partkey, near, min(directory || '/S' || p_partkey || '.app') AS path, count(*) AS n FROM {APPENDICES} WHERE near < 4 GROUP BY ALL),
        b AS (SELECT p_partkey, arg_min(path, near) AS path, arg_min(n, near) AS n FROM a GROUP BY p_partkey)
        SELECT p_partkey AS subbook, CASE WHEN n = 1 THEN path END AS path, coalesce(n, 0) AS found, CASE WHEN n IS NULL THEN 'no appendix' WHEN n > 1 THEN 'several appendices' END AS error FROM part LEFT JOIN b USING (p_partkey)"""
)
def src_appendix_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subbook for each part, and files beside the books, in the book's directory, and in others."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    books = p.select(k.alias("subbook"), F.concat(F.lit("/c/b"), size).alias("book"), F.concat(F.lit("s"), k.cast("string")).alias("directory"), F.lit(None).cast("string").alias("where"))
    places = [F.when(k % 4 == 0, F.lit("")), F.when(k % 5 == 0, F.concat(F.lit("/B"), size)), F.when(k % 3 == 0, F.concat(F.lit("/x"), size)), F.when(k % 6 == 0, F.concat(F.lit("/y"), size)), F.when(k % 7 == 0, F.lit("/y/z"))]
    listing = p.select(F.explode(F.array_compact(F.array(*places))).alias("at"), F.concat(F.lit("S"), k.cast("string"), F.lit(".app")).alias("name"))
    return T.appendix_of(books, listing.select(F.concat(F.lit("/c/appendix"), "at").alias("directory"), "name"))


@query(
    """SELECT subbook, CASE WHEN odd THEN 8001 ELSE 7945 END::BIGINT AS code, CASE WHEN odd THEN 256 ELSE 1 END::BIGINT AS argument
        FROM (SELECT p_brand AS subbook, right(p_brand, 1)::INT % 2 = 1 AS odd, count(*) AS n FROM part GROUP BY ALL) WHERE n >= 8"""
)
def stop_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subbook for each brand, an entry for each part. Entries begin with an indent and a keyword; odd brands indent within entries as well."""
    odd = F.substring("p_brand", -1, 1).cast("int") % 2 == 1
    p = numbered(table(spark, sf_dir, "part"), "p_brand", "p_partkey")
    entry = F.concat(F.lit("1F0900011F410100" + "2422" * 3 + "1F61" + "2424" * 24), F.when(odd & (F.col("nth") % 4 == 0), "1F090001" + "2426" * 8).otherwise(""), F.lit("2424" * 24))
    # Leaves begin on page 1, texts on a page that no number of leaves reaches.
    text_page = 1 << 22
    first = text_page * 2048
    p = running_total(p.withColumn("entry", entry), ["p_brand"], "nth", (F.length("entry") / 2).cast("long"), "at")
    p = p.withColumns({"at": F.col("at") + first, "leaf": F.floor(F.col("nth") / 100) + 1})
    record = F.concat(be(F.col("nth"), 4), be(F.floor(F.col("at") / 2048) + 1, 4), be(F.col("at") % 2048, 2), F.lit("000000010000"))
    own = joined(p, ["p_brand", "leaf"], "nth", record)
    leaf_pages = own.select(F.col("p_brand").alias("subbook"), F.col("leaf").alias("page"), F.rpad(F.concat(F.lit("A004"), be(F.col("n"), 2), F.col("hex")), 4096, "0").alias("hex"))
    texts = page_stream(p, "p_brand", "nth", F.col("entry"))
    text_pages = texts.select(F.col("p_brand").alias("subbook"), (F.col("page") + text_page + 1).alias("page"), F.rpad("hex", 4096, "0").alias("hex"))
    pages = leaf_pages.unionByName(text_pages).select("subbook", "page", F.unhex("hex").alias("bytes"))
    indexes = own.groupBy(F.col("p_brand").alias("subbook")).agg(F.max("leaf").alias("end_page")).select("subbook", F.lit("word_asis").alias("name"), F.lit(1).cast("long").alias("start_page"), "end_page")
    books = indexes.select("subbook")
    return Collection(spark, books, pages, indexes).stop_codes().select("subbook", "code", "argument")
