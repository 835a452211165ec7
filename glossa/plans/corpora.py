"""Dictionary-like corpora made of the driver's tables, in DataFrames and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import HIRAGANA, KATAKANA
from .registry import table

LATIN = "abcdefghijklmnopqrstuvwxyz "
#: Letters as kana: voiced, small, contracted and long ones among them.
AS_KANA = "アバカダーフガハィジキルマンオパヵラサッウヴワャヤザ　"
LOWER, UPPER = LATIN[:26], LATIN[:26].upper()


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_map(x: str, table_: dict[str, str]) -> str:
    return f"translate({x}, {quoted(''.join(table_))}, {quoted(''.join(table_.values()))})"


def kana(name: Column) -> Column:
    return F.translate(name, LATIN, AS_KANA)


KANA_SQL = f"translate(p_name, '{LATIN}', '{AS_KANA}')"
TO_KATA = f"'{HIRAGANA}', '{KATAKANA}'"
TO_HIRA = f"'{KATAKANA}', '{HIRAGANA}'"


def kana_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, x: part names in katakana, every third one in hiragana."""
    p = table(spark, sf_dir, "part")
    k = kana(F.col("p_name"))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.translate(k, KATAKANA, HIRAGANA)).otherwise(k).alias("x"))


KANA_PARTS = f"(SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN translate({KANA_SQL}, {TO_HIRA}) ELSE {KANA_SQL} END AS x FROM part)"


def headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries of part names: ord, subbook, key, key_rev, text, heading. Many share key and target."""
    p = table(spark, sf_dir, "part")
    key = F.translate(F.translate("p_name", LOWER, UPPER), " ", "")
    return p.select(
        F.col("p_partkey").alias("ord"),
        F.col("p_brand").alias("subbook"),
        key.alias("key"),
        F.reverse(key).alias("key_rev"),
        (F.col("p_size").cast("long") * 2048 + F.col("p_partkey") % 5).alias("text"),
        (F.col("p_partkey") % 3).alias("heading"),
    )


HEADWORDS = f"(SELECT p_partkey AS ord, p_brand AS subbook, replace(translate(p_name, '{LOWER}', '{UPPER}'), ' ', '') AS key, reverse(replace(translate(p_name, '{LOWER}', '{UPPER}'), ' ', '')) AS key_rev, p_size::BIGINT * 2048 + p_partkey % 5 AS text, p_partkey % 3 AS heading FROM part)"


def word_queries(spark: SparkSession, sf_dir: str, length: Column | None = None) -> DataFrame:
    """query, word: beginnings of 3 to 5 letters of all headwords."""
    h = headwords(spark, sf_dir)
    n = F.col("ord") % 3 + 3
    return h.select(F.substring("key", F.lit(1), n.cast("int")).alias("word")).distinct().withColumn("query", F.col("word"))


WORD_QUERIES = f"(SELECT DISTINCT left(key, (ord % 3 + 3)::INT) AS word, left(key, (ord % 3 + 3)::INT) AS query FROM {HEADWORDS})"


def grouped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped index: headers, members and singles in index order, one index a brand."""
    h = headwords(spark, sf_dir)
    n = F.col("ord") % 7
    return h.withColumn("kind", F.when(n == 0, "header").when(n == 5, "single").otherwise("member"))


GROUPED = f"(SELECT *, CASE ord % 7 WHEN 0 THEN 'header' WHEN 5 THEN 'single' ELSE 'member' END AS kind FROM {HEADWORDS})"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries: the sources of documents, with a category by their main language and a headword size."""
    d = table(spark, sf_dir, "documents")
    cat = F.when(F.col("lang") == "en", "英").when(F.col("lang").isin("fr", "de"), "国").otherwise("百")
    each = d.groupBy(F.col("source").alias("name"), cat.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("name").agg(F.max_by("category", F.struct("n", "category")).alias("category"), F.sum("n").alias("size"))


SOURCES = """(SELECT name, arg_max(category, (n, category)) AS category, sum(n)::BIGINT AS size FROM (
    SELECT source AS name, CASE WHEN lang = 'en' THEN '英' WHEN lang IN ('fr', 'de') THEN '国' ELSE '百' END AS category, count(*) AS n FROM documents GROUP BY ALL) GROUP BY name)"""
