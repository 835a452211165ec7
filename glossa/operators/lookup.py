"""Headword lookup: batches of queries joined to index entries, and single words pushed down to the scan.

Entries: ord (index order), key (normalised), text and heading (locations), and optionally key_rev (the key
backwards). Queries: query (their number) and word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import word_class


def lookup(entries: DataFrame, word: str, exact: bool = False, backward: bool = False, limit: int | None = 30) -> DataFrame:
    """One word's hits in index order. The filter on the key reaches the scan; suffixes are prefixes of key_rev."""
    key, w = (F.col("key_rev"), word[::-1]) if backward else (F.col("key"), word)
    found = first_hits(entries.where(key == w if exact else F.startswith(key, F.lit(w))), [])
    ranked = found.orderBy("ord")
    return ranked.limit(limit) if limit is not None else ranked


def matched(queries: DataFrame, entries: DataFrame, key: str = "key", exact: bool = False, on: Sequence[str] = ()) -> DataFrame:
    """queries joined to the entries whose key begins with (or equals) the word, and whose columns ``on`` are equal.

    A prefix join is an equality join on the key's beginning, once for each length that a query's word has:
    at most 127 lengths, since words are no longer. An empty word meets every entry, as one query of length 0.
    """
    if exact:
        return queries.join(entries.withColumn("word", F.col(key)), ["word", *on])
    lengths = [r[0] for r in queries.where("word IS NOT NULL").select(F.length("word")).distinct().collect()]
    if not lengths:
        return queries.join(entries, F.lit(False))
    begins = F.array(*[F.substring(key, 1, n) for n in sorted(lengths)])
    # Shorter keys would repeat themselves.
    each = F.explode(F.array_distinct(F.filter(F.zip_with(begins, F.array(*map(F.lit, sorted(lengths))), lambda b, n: F.when(F.length(b) == n, b)), lambda b: b.isNotNull())))
    keyed = entries.withColumn("__begin", each)
    return queries.join(keyed.withColumnRenamed("__begin", "word"), ["word", *on])


def first_hits(hits: DataFrame, by: list[str], identity: tuple[str, ...] = ("text", "heading")) -> DataFrame:
    """Distinct hits, each with its first place in index order; minima are taken before the shuffle."""
    return hits.groupBy(*by, *identity).agg(F.min("ord").alias("ord"))


def limited(hits: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first n hits of each query; each task keeps n per query before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("ord"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= n)


def search(queries: DataFrame, entries: DataFrame, key: str = "key", exact: bool = False, identity: tuple[str, ...] = ("text", "heading"), limit: int | None = 30) -> DataFrame:
    """Distinct hits of each query in index order: the distinct comes before the limit."""
    hits = first_hits(matched(queries.select("query", "word"), entries, key, exact), ["query"], identity)
    return limited(hits, ["query"], limit) if limit is not None else hits


def preferred_indexes(word: Column, backward: Column, script: str | None = None) -> Column:
    """Names of the indexes that serve a word, the best first."""
    kind = F.when(backward, "endword").otherwise("word")
    found = F.lit(script) if script else word_class(word)
    own = F.when(found == "other", F.lit(None)).otherwise(F.concat(kind, F.lit("_"), found))
    return F.array_compact(F.array(own, F.concat(kind, F.lit("_asis"))))


def selected_index(queries: DataFrame, indexes: DataFrame, script: str | None = None) -> DataFrame:
    """queries (query, word, backward) with the index that serves each in each subbook; null name where none does.

    indexes: subbook, name. The best two names are looked up, so a query meets two indexes of a subbook at most. The words' script
    decides, unless they are all of one ``script``.
    """
    wanted = queries.select("*", F.posexplode(preferred_indexes(F.col("word"), F.col("backward"), script)).alias("preference", "name"))
    there = wanted.join(indexes, "name")
    best = there.groupBy("query", "subbook").agg(F.min_by("name", "preference").alias("index_name"))
    return queries.join(best, "query", "left")


def interleaved(hits: DataFrame, source: str, source_order: Column, hits_per_round: Column, per_source: int = 40) -> DataFrame:
    """Hits of many sources in one list: so many of each source in a round, sources in their order.

    The first ``per_source`` hits of each source are kept in every task before the shuffle, so the list that
    one task numbers has ``per_source`` rows a source.
    """
    top = limited(hits, [source], per_source)
    rounds = top.withColumn("round", F.floor((F.col("rank") - 1) / hits_per_round)).withColumn("__order", source_order)
    place = F.row_number().over(Window.partitionBy().orderBy("round", "__order", "rank"))
    return rounds.withColumn("place", place).drop("__order")
