"""Inverted-index queries: entries that use all of some words, and fields that must all match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import written

WORD = "[A-Za-z]+"


def entry_words(docs: DataFrame, text: str = "doc_id", body: str = "text") -> DataFrame:
    """text, words: the distinct upper-cased words of an entry."""
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col(body), F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(WORD), F.lit(0)))
    return docs.select(F.col(text).alias("text"), words.alias("words"))


def postings(docs: DataFrame, text: str = "doc_id", body: str = "text") -> DataFrame:
    """keyword, text: one row for each distinct upper-cased word of an entry."""
    return entry_words(docs, text, body).select("text", F.explode("words").alias("keyword"))


def asked_postings(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """The postings of the words that some query asks for; entries: text, words."""
    return entries.select("text", F.explode("words").alias("keyword")).join(queries.select("keyword").distinct(), "keyword", "left_semi")


def keyword_and(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """query, text: entries that use all words of a query. queries: query, nth, keyword, one row per distinct word; entries: text, words.

    The list of each query's rarest word is walked, and its entries are looked up in the lists of the other words, so that a
    common word's list never meets the queries. Entries are taken apart once: the postings of asked words are written.
    Their file is far smaller than their rows, so that its size must not let the planner broadcast them.
    """
    posts = written(asked_postings(queries, entries), "postings")
    drivers = rarest(queries, document_frequency(posts)).where("df > 0").select("query", F.col("driver").alias("keyword"))
    walked = posts.hint("merge").join(drivers, "keyword")
    others = queries.select("query", F.col("keyword").alias("other"))
    need = others.groupBy("query").agg(F.count(F.lit(1)).alias("need"))
    asked = walked.join(others, "query").where("other <> keyword").select("query", "text", F.col("other").alias("keyword"))
    met = asked.join(posts.hint("merge"), ["text", "keyword"]).select("query", "text")
    # A query's own driver counts as one of its words.
    found = walked.select("query", "text").unionByName(met).groupBy("query", "text").agg(F.count(F.lit(1)).alias("met"))
    return found.join(need, "query").where("met = need").select("query", "text")


def document_frequency(posts: DataFrame) -> DataFrame:
    """keyword, df: postings are distinct already, so counting them is enough."""
    return posts.groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))


def rarest(queries: DataFrame, frequencies: DataFrame) -> DataFrame:
    """query, driver, df: each query's rarest word, whose list is walked; the first typed one among equals.

    queries: query, nth, keyword. A word without postings has df 0 and makes the query empty.
    """
    rated = queries.join(frequencies, "keyword", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return rated.groupBy("query").agg(F.min_by("keyword", F.struct("df", "nth")).alias("driver"), F.min("df").alias("df"))


def multi_lists(hits: DataFrame, asked: DataFrame) -> DataFrame:
    """query, text, heading, ord: texts that stand in the lists of all fields that a query asks for.

    hits: query, field_no, text, heading, ord, the lists' entries that fit their words; asked: query, field_no, one row
    per field. Order and heading are those of the query's first field, where a text stands first. A field without hits
    leaves its query none. Lists shrink to one row a text in each task before they meet.
    """
    need = asked.groupBy("query").agg(F.countDistinct("field_no").alias("need"))
    each = hits.groupBy("query", "text", "field_no").agg(F.min(F.struct("ord", "heading")).alias("x"))
    met = each.groupBy("query", "text").agg(F.count(F.lit(1)).alias("met"), F.min_by("x", "field_no").alias("x"))
    return met.join(need, "query").where("met = need").select("query", "text", "x.heading", "x.ord")


def multi_and(entries: DataFrame, fields: list[tuple[str, str]], exact: bool = False) -> DataFrame:
    """Entries whose every asked field begins with (or is) its word; blank and "-" fields aren't asked."""
    asked = [(f, w) for f, w in fields if w.strip() not in ("", "-")]
    test = lambda f, w: F.col(f) == w if exact else F.startswith(F.col(f), F.lit(w))
    return entries.where(reduce(Column.__and__, [test(f, w) for f, w in asked], F.lit(bool(asked))))
