"""Queries over whole discs and their files. Pages are made of the driver's tables; SQL over the tables says what they must give."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normalize import ASCII_WIDE
from ..operators import stored_index as I
from ..operators.stored import fresh_path
from ..sources.collection import Collection
from ..sources.ranges import disc_pages
from .corpora import HEADWORDS, WORD_QUERIES, headwords, sql_map, word_queries
from .discs import be, jis, joined, numbered, page_stream
from .registry import query, table

#: Documents in one file: files are bounded, and their number grows with the table.
PER_FILE = 500
FILES = f"(SELECT doc_id // {PER_FILE} AS file, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY ALL)"


def text_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for every so many documents: their texts, a line end after each."""
    d = table(spark, sf_dir, "documents").select((F.expr(f"doc_id DIV {PER_FILE}")).alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    path = fresh_path(spark, "files")
    d.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(path)
    return path


def file_of(pages: DataFrame) -> DataFrame:
    return pages.withColumn("file", F.regexp_extract("path", "file=([0-9]+)/", 1).cast("long"))


def whole(pages: DataFrame) -> DataFrame:
    """file, pages, size and md5 of the pages put together."""
    each = pages.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", F.hex("bytes").alias("h")))).alias("x"), F.sum(F.octet_length("bytes")).alias("size"))
    return each.select("file", F.size("x").cast("long").alias("pages"), F.col("size").cast("long"), F.md5(F.unhex(F.array_join(F.transform("x", lambda v: v["h"]), ""))).alias("digest"))


@query(f"SELECT file, (strlen(content) + 2047) // 2048 AS pages, strlen(content)::BIGINT AS size, md5(content) AS digest FROM {FILES}")
def src_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of many pages read by ranges of 64 KiB, a task each, and put together again."""
    return whole(file_of(disc_pages(spark, text_files(spark, sf_dir), range_bytes=1 << 16)))


@query(f"SELECT file, p::BIGINT AS page, md5(encode(content)[2048 * (p - 1) + 1 : 2048 * p]) AS digest FROM {FILES}, (SELECT unnest([2, 3]) AS p) WHERE strlen(content) > 2048 * (p - 1)")
def src_page_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second and third page of each file: nothing else is read."""
    pages = file_of(disc_pages(spark, text_files(spark, sf_dir), first=2, last=3))
    return pages.select("file", "page", F.md5("bytes").alias("digest"))


def packed_files(spark: SparkSession, sf_dir: str) -> str:
    """The same files compressed, and every ninth slice damaged: its first byte is turned."""

    @F.pandas_udf("binary")
    def packed(content: pd.Series) -> pd.Series:
        import zlib

        def one(data: bytes) -> bytes:
            slices = [zlib.compress(data[i : i + 4096].ljust(4096, b"\0")) for i in range(0, len(data), 4096)]
            slices = [bytes([s[0] ^ 0xFF]) + s[1:] if i % 9 == 8 else s for i, s in enumerate(slices)]
            width = 2 if len(data) < 1 << 16 else 3 if len(data) < 1 << 24 else 4
            at, offsets = 22 + width * (len(slices) + 1), []
            for s in [*slices, b""]:
                offsets.append(at.to_bytes(width, "big"))
                at += len(s)
            return b"EBZip\x11\0\0\0" + len(data).to_bytes(5, "big") + bytes(8) + b"".join(offsets) + b"".join(slices)

        return pd.Series([one(x) for x in content])

    d = table(spark, sf_dir, "documents").select(F.expr(f"doc_id DIV {PER_FILE}").alias("file"), "doc_id", F.hex(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))).alias("h"))
    files = joined(d, ["file"], "doc_id", F.col("h")).select("file", packed(F.unhex("hex")).cast("string").alias("value"))
    path = fresh_path(spark, "packed")
    files.repartition("file").write.partitionBy("file").text(path)
    return path


@query(
    f"""SELECT file, p::BIGINT AS page, CASE WHEN (p - 1) // 2 % 9 < 8 THEN md5(encode(content)[2048 * (p - 1) + 1 : 2048 * p]) END AS digest, (p - 1) // 2 % 9 = 8 AS damaged
        FROM (SELECT *, unnest(range(1, (strlen(content) + 2047) // 2048 + 1)) AS p FROM {FILES})"""
)
def src_damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed files with damaged slices, permissively: their pages are rows with an error, all others have their bytes."""
    pages = file_of(disc_pages(spark, packed_files(spark, sf_dir), range_bytes=1 << 16, mode="permissive"))
    return pages.select("file", "page", F.md5("bytes").alias("digest"), F.col("error").isNotNull().alias("damaged"))


@query(f"SELECT file, count(*) FILTER ((p - 1) // 2 % 9 < 8) AS pages FROM (SELECT *, unnest(range(1, (strlen(content) + 2047) // 2048 + 1)) AS p FROM {FILES}) GROUP BY file")
def src_dropped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files where what can't be read is left out."""
    pages = file_of(disc_pages(spark, packed_files(spark, sf_dir), range_bytes=1 << 16, mode="drop"))
    return pages.groupBy("file").agg(F.count(F.lit(1)).alias("pages"))


def disc(spark: SparkSession, pages: DataFrame, indexes: DataFrame, latin: Column | None = None) -> Collection:
    """A collection of pages and indexes (subbook, index_id, name, start_page, end_page). latin: which subbooks are Latin books."""
    subbooks = indexes.select("subbook").distinct().select("subbook", F.when(latin, 1).otherwise(2).alias("charset") if latin is not None else F.lit(2).alias("charset"), F.lit("EPWING").alias("disc"))
    zero = F.lit(0).cast("long")
    return Collection(spark, subbooks, pages, indexes.withColumns({"nth": zero, "flags": zero, "available": zero, "overall": zero}))


def numbered_parts(spark: SparkSession, sf_dir: str, per_page: int) -> DataFrame:
    """Parts with their number in their brand, and the page and slot that this gives. A brand is a subbook."""
    words = F.split("p_name", " ")
    p = numbered(table(spark, sf_dir, "part"), "p_brand", "p_partkey").withColumns({"first": F.upper(words[0]), "second": F.upper(words[1])})
    return p.withColumns({"page": F.expr(f"nth DIV {per_page} + 1"), "in_page": F.col("nth") % per_page})


def leaf_pages(rows: DataFrame, head: Column, value: Column, entries: int) -> DataFrame:
    own = joined(rows, ["p_brand", "page"], "nth", value)
    own = own.join(rows.groupBy("p_brand", "page").agg(F.first(head).alias("head")), ["p_brand", "page"])
    return own.select(F.col("p_brand").alias("subbook"), "page", F.unhex(F.rpad(F.concat("head", be(F.col("n") * entries, 2), F.col("hex")), 4096, "0")).alias("bytes"))


def place(loc: Column) -> Column:
    return F.concat(be(F.floor(loc / 2048) + 1, 4), be(loc % 2048, 2))


LATIN_BRAND = "substr(p_brand, 7)::INT % 3 = 0"
DISC_WORDS = "(SELECT DISTINCT left(p_name, 3) AS query FROM part)"
DISC_HITS = f"""(SELECT query, p_brand AS subbook, p_partkey, row_number() OVER (PARTITION BY query, p_brand ORDER BY p_partkey)::INT AS rank
    FROM (SELECT *, upper(string_split(p_name, ' ')[1]) AS w1, upper(string_split(p_name, ' ')[2]) AS w2 FROM part) JOIN {DISC_WORDS} ON
        CASE WHEN {LATIN_BRAND} THEN starts_with(upper(p_name), upper(query)) ELSE starts_with(w1, upper(query)) AND starts_with(CASE WHEN p_size % 2 = 0 THEN w1 ELSE w2 END, upper(query)) END)"""


@query(f"SELECT query, subbook, p_partkey AS text, p_partkey + 1 AS heading, rank FROM {DISC_HITS} WHERE rank <= 5")
def disc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case words in subbooks of grouped leaves and in Latin ones. Some members don't fit their group's word, some groups not their members'."""
    p = numbered_parts(spark, sf_dir, 20).withColumn("latin", F.substring("p_brand", 7, 9).cast("int") % 3 == 0)
    key = lambda c: F.concat(be(F.length(c), 1), c)
    wide = lambda c: F.concat(be(F.length(c) * 2, 1), jis(c))
    at = F.concat(place(F.col("p_partkey")), place(F.col("p_partkey") + 1))
    member = F.when(F.col("p_size") % 2 == 0, F.col("first")).otherwise(F.col("second"))
    group = F.concat(F.lit("80"), be(F.length("first") * 2, 1), F.lit("0001"), jis(F.col("first")), F.lit("C0"), wide(member), at)
    own = F.hex(F.encode(F.upper("p_name"), "ISO-8859-1"))
    value = F.when(F.col("latin"), F.concat(be(F.length(own) / 2, 1), own, at)).otherwise(group)
    pages = leaf_pages(p.where("latin"), F.lit("A000"), value, 1).unionByName(leaf_pages(p.where("NOT latin"), F.lit("B000"), value, 2))
    indexes = p.groupBy(F.col("p_brand").alias("subbook")).agg(F.max("page").alias("end_page")).select("subbook", F.lit(0x91).cast("long").alias("index_id"), F.lit("word_asis").alias("name"), F.lit(1).cast("long").alias("start_page"), "end_page")
    asked = p.select(F.substring("p_name", 1, 3).alias("query")).distinct().select("query", F.col("query").alias("word"), F.lit(False).alias("backward"))
    hits = disc(spark, pages, indexes, F.substring("subbook", 7, 9).cast("int") % 3 == 0).search(asked, limit=5)
    return hits.select("query", "subbook", "text", "heading", "rank")


@query(
    f"""SELECT query, p_brand AS subbook, p_partkey AS text, rank, {sql_map("p_name", ASCII_WIDE)} AS heading_text
        FROM (SELECT *, 'all' AS query, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS rank FROM part) WHERE rank <= 90"""
)
def disc_keyword_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword that all parts of a brand use: one group over many pages, its headings in one stream, which is read as far as hits are shown."""
    p = numbered_parts(spark, sf_dir, 60)
    member = F.concat(F.lit("C0"), place(F.col("p_partkey")))
    heads = (1 << 22) * 2048  # no number of leaves reaches the page
    header = F.concat(F.lit("8006"), be(F.lit(1), 4), jis(F.lit("ALL")), place(F.lit(heads)))
    body = leaf_pages(p.where("nth > 0"), F.lit("B000"), member, 1)
    first = leaf_pages(p.where("nth = 0").withColumn("page", F.lit(0).cast("long")), F.lit("B000"), F.concat(header, member), 2)
    leaves = first.unionByName(body).withColumn("page", F.col("page") + 1)
    # The headings of a brand stand one after the other, each with its line end, over pages.
    heading = F.concat(jis(F.col("p_name")), F.lit("1F0A"))
    streams = page_stream(p, "p_brand", "nth", heading)
    texts = streams.select(F.col("p_brand").alias("subbook"), (F.col("page") + heads // 2048 + 1).alias("page"), F.unhex("hex").alias("bytes"))
    indexes = p.groupBy(F.col("p_brand").alias("subbook")).agg((F.max("page") + 1).alias("end_page")).select("subbook", F.lit(0x80).cast("long").alias("index_id"), F.lit("keyword").alias("name"), F.lit(1).cast("long").alias("start_page"), "end_page")
    c = disc(spark, leaves.unionByName(texts), indexes)
    hits = c.keyword_search(spark.range(1).select(F.lit("all").alias("query"), F.lit(0).alias("nth"), F.lit(" all ").alias("word")), limit=90)
    return c.keyword_headings(hits).select("query", "subbook", "text", "rank", "heading_text")


BLOCK = 100


def _wide(x: str) -> str:
    return sql_map(x, ASCII_WIDE)


@query(
    f"""WITH b AS (SELECT *, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // {BLOCK} AS block FROM customer)
        SELECT 1 AS level, {_wide("r_name")} AS label, count(*) AS lines FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) GROUP BY ALL
        UNION ALL SELECT 2, {_wide("replace(n_name, '_', ' ')")}, count(*) FROM nation GROUP BY ALL
        UNION ALL SELECT 3, {_wide("'part ' || block")}, count(*) FROM (SELECT DISTINCT c_nationkey, block FROM b) GROUP BY block
        UNION ALL SELECT 4, {_wide("replace(c_name, '#', ' ')")}, count(*) FROM b GROUP BY c_name
        UNION ALL SELECT 4, {_wide("'top'")}, count(*) FROM (SELECT DISTINCT c_nationkey, block FROM b)"""
)
def disc_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A menu of regions, nations, blocks of customers and customers, whose lowest pages lead back to its top: each page is read once."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nth = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    c = c.withColumn("block", F.floor(nth / BLOCK))
    node = lambda level, key: (F.lit(level) * (1 << 24) + key) * 8 + 1  # noqa: E731  a menu has eight pages
    bcd = lambda page: F.concat(F.lpad(page.cast("string"), 8, "0"), F.lit("0001"))
    line = lambda label, target: F.concat(F.lit("1F43"), jis(label), F.lit("1F63"), target, F.lit("1F0A"))
    blocks = c.groupBy("c_nationkey", "block").agg(F.count(F.lit(1)).alias("n"))
    block_key = F.col("c_nationkey") * 4096 + F.col("block")
    rows = [
        r.join(n.select(F.col("n_regionkey").alias("r_regionkey")).distinct(), "r_regionkey").select(F.lit(1).cast("long").alias("page"), F.col("r_regionkey").cast("long").alias("o"), line(F.col("r_name"), bcd(node(0, F.col("r_regionkey") + 1))).alias("v")),
        n.select(node(0, F.col("n_regionkey") + 1).alias("page"), F.col("n_nationkey").cast("long").alias("o"), line(F.regexp_replace("n_name", "_", " "), bcd(node(0, F.col("n_nationkey") + 4096))).alias("v")),
        blocks.select(node(0, F.col("c_nationkey") + 4096).alias("page"), F.col("block").cast("long").alias("o"), line(F.concat(F.lit("part "), F.col("block").cast("string")), bcd(node(1, block_key) % 100_000_000)).alias("v")),
        c.select((node(1, block_key) % 100_000_000).alias("page"), F.col("c_custkey").alias("o"), line(F.regexp_replace("c_name", "#", " "), F.lit("0" * 12)).alias("v")),
        blocks.select((node(1, block_key) % 100_000_000).alias("page"), F.lit(1 << 60).alias("o"), line(F.lit("top"), bcd(F.lit(1))).alias("v")),
    ]
    lines = rows[0]
    for more in rows[1:]:
        lines = lines.unionByName(more)
    menus = joined(lines, ["page"], "o", F.col("v")).withColumn("hex", F.concat(F.lit("1F02"), F.col("hex"), F.lit("1F03")))
    cut = menus.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("hex") - 1) / 4096))))
    pages = cut.select(F.lit("atlas").alias("subbook"), (F.col("page") + F.col("i")).cast("long").alias("page"), F.unhex(F.rpad(F.substring("hex", (F.col("i") * 4096 + 1).cast("int"), F.lit(4096)), 4096, "0")).alias("bytes"))
    indexes = spark.range(1).select(F.lit("atlas").alias("subbook"), F.lit(1).cast("long").alias("index_id"), F.lit("menu").alias("name"), F.lit(1).cast("long").alias("start_page"), F.lit(1).cast("long").alias("end_page"))
    return disc(spark, pages, indexes).menu_tree().groupBy("level", "label").agg(F.count(F.lit(1)).alias("lines"))


def _stored_sql(test: str) -> str:
    return f"SELECT query, ord, text, heading FROM {WORD_QUERIES} JOIN {HEADWORDS} ON {test}"


@query(_stored_sql("starts_with(key, word)"))
def stored_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of words against an index that is stored in ranges of its keys: the entries aren't shuffled again."""
    return I.write_index(headwords(spark, sf_dir), "key", bucket_rows=2_000).matched(word_queries(spark, sf_dir)).select("query", "ord", "text", "heading")


@query(_stored_sql("ends_with(key, word)"))
def stored_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that keys end with, as beginnings of keys stored backwards."""
    asked = word_queries(spark, sf_dir).select("query", F.reverse("word").alias("word"))
    return I.write_index(headwords(spark, sf_dir), "key_rev", bucket_rows=2_000).matched(asked).select("query", "ord", "text", "heading")


@query(f"SELECT k.key AS query, h.ord, h.text, h.heading FROM (SELECT DISTINCT key FROM {HEADWORDS}) k JOIN {HEADWORDS} h ON h.key = k.key")
def stored_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headwords(spark, sf_dir)
    asked = h.select(F.col("key").alias("query"), F.col("key").alias("word")).distinct()
    return I.write_index(h, "key", bucket_rows=2_000).matched(asked, exact=True).select("query", "ord", "text", "heading")


@query(
    f"""WITH stops AS (SELECT query, min(ord) AS stop FROM {WORD_QUERIES} JOIN {HEADWORDS} ON key > word AND NOT starts_with(key, word) GROUP BY query)
        SELECT q.query, ord, text, heading FROM {WORD_QUERIES} q JOIN {HEADWORDS} ON starts_with(key, word) LEFT JOIN stops USING (query) WHERE stop IS NULL OR ord < stop"""
)
def scan_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that isn't in the order of its keys, read as a scan reads it: a word's hits end at the first key beyond it."""
    index = I.write_index(headwords(spark, sf_dir), "key", bucket_rows=2_000)
    return index.taken_while(word_queries(spark, sf_dir)).select("query", "ord", "text", "heading")
