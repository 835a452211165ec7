"""Sharding by rendezvous hashing: each record goes to the shard that draws the best score for its key.

A shard's draw depends on the record's key and the shard's own number alone, so another shard takes only the records
for which its draw is best, and a shard that leaves gives up only its own. With weights a shard's share of all
records is its share of all weights, and a changed weight moves records only from or to that shard.

Places within shards are numbered in two levels: rows are range-partitioned by shard and key, numbered within each
partition, and the partitions' counts are summed up. No task holds a whole shard.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Hexadecimal digits of a draw that count: 52 bits, which a double holds.
DIGITS = 13


def record_key(col: Column) -> Column:
    """A key as text; a null key is one of its own, unlike any text."""
    return F.coalesce(F.concat(F.lit("k"), col.cast("string")), F.lit("-"))


def best_shard(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of least -ln(u) / weight, where u is drawn by shard and key; of equal ones the first listed.

    Shards without weight take nothing. With one weight for all this is the shard with the largest draw.
    """
    shards = {s: float(w) for s, w in sorted(weights.items()) if w > 0}
    if not shards:
        raise ValueError("no shard has a weight")
    draws = {s: F.substring(F.md5(F.concat(F.lit(f"{s}:"), key)), 1, DIGITS) for s in shards}
    if len(set(shards.values())) == 1:
        scores = [F.struct(d.alias("draw"), F.lit(-s).alias("shard")) for s, d in draws.items()]
        return (-_most(scores)["shard"]).cast("int")
    u = lambda d: (F.conv(d, 16, 10).cast("double") + 1) / float(16**DIGITS + 1)  # noqa: E731  never 0 or 1
    scores = [F.struct((F.log(u(d)) / w).alias("score"), d.alias("draw"), F.lit(-s).alias("shard")) for (s, d), w in zip(draws.items(), shards.values(), strict=True)]
    return (-_most(scores)["shard"]).cast("int")


def _most(scores: list[Column]) -> Column:
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def numbered(rows: DataFrame, by: str, order: Sequence[str], name: str) -> DataFrame:
    """rows with a gapless number from 0 in each group of ``by``, in the order of ``order``, then of all other columns.

    Rows that are equal in all columns may stand in either order. They are spread by a salt, as one of them may be
    repeated very often.
    """
    # Callers' columns travel as one, so that none of them meets the names used here.
    row = lambda c: F.col(f"row.`{c}`")
    sort = [row(by).asc_nulls_last(), *[row(c).asc_nulls_last() for c in order], F.col("salt")]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    ranged = packed.repartitionByRange(*sort).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*sort)
    # The range partitioning is kept in a table: its counts and its rows then come from the same partitions.
    kept = written(ranged.select("row", "part", row(by).alias("by"), F.monotonically_increasing_id().alias("at")), "ranged")
    counts = kept.groupBy("part", "by").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # One row for each partition and the few groups in it, whatever the number of rows.
    before = F.sum("n").over(Window.partitionBy("by").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(counts.select("part", "by", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "starts")
    found = kept.join(starts, (kept["part"] == starts["part"]) & kept["by"].eqNullSafe(starts["by"])).select(kept["row"], (kept["at"] + starts["shift"]).alias("number"))
    return found.select(*[row(c).alias(c) for c in rows.columns], F.col("number").alias(name))


def placed(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, key: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs' columns and size, text_crc32, law, shard and grown_shard, in one pass without a shuffle; see ``sharded``."""
    key = record_key(F.col(id_col) if key is None else key)
    text = F.coalesce(F.col(text_col), F.lit(""))
    new = {
        "size": (F.octet_length(text) + 1).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "law": F.lit("key"),
        "shard": best_shard(key, weights),
        "grown_shard": best_shard(key, grown) if grown else F.lit(None).cast("int"),
    }
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def sharded(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, key: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs' columns and size, text_crc32, law, shard, grown_shard and slot, which take the place of columns so named.

    The shard follows from the key (``doc_id`` if none is given) and the weights alone, so rows that repeat a key,
    with the same or other texts, are in one shard, and rows without a key are in one, too. size is the text's
    UTF-8 bytes plus 1, text_crc32 their CRC-32; a null or empty text has size 1 and CRC 0; long texts are hashed
    whole. slot counts from 0 without gaps in each shard, in the order of the id, size and CRC; equal rows have slots
    next to each other. grown_shard is the shard under the weights ``grown``, null without them. An empty table gives
    an empty result.
    """
    return numbered(placed(docs, weights, grown, key, text_col, id_col).drop("slot"), "shard", [id_col, "size", "text_crc32"], "slot")
