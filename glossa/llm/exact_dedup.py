"""Exact deduplication by content sort.

Rows are range-partitioned on their normalised bytes by splitters that Spark samples, sorted there
externally, and neighbours compared in full: a run of equal texts gives each of its rows the smallest id and the
size. The sort key starts with a bounded prefix of the bytes and their hash, so that the sampled splitters stay
small however long the texts are. A content that fills more than a partition's share of a bounded sample is salted
over neighbouring partitions; only the runs of such contents, a few for each, meet again by digest.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import squeezed, text_or_empty, written


def crowded_contents(docs: DataFrame, text_col: str, sample_rows: int = 20_000) -> dict[int, int]:
    """Hashes of the contents that fill a large part of a sample, with their counts: a few rows reach the driver.

    A content that the sample misses only makes a task longer. The sample has about ``sample_rows`` rows, counted
    in the executors; those with under 8 rows or a quarter of a partition's share aren't returned.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    least = max(8, sample_rows // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    seen = docs.sample(share, seed=3).select(F.xxhash64(squeezed(text_or_empty(text_col))).alias("h"))
    return Counter({r.h: r.n for r in seen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()})


def content_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, prefix: int = 24, sample_rows: int = 20_000) -> DataFrame:
    """One row per input row: id, text_sha256, salted, run_first (missing, id, salt), run_size and nth, its place in its run.

    Without a salt a run is the whole group of equal texts; with one there are at most ``salts`` runs of it.
    """
    hot = crowded_contents(docs, text_col, sample_rows)
    salt: Column = F.lit(0)
    if hot:
        salt = F.when(F.col("h").isin(*hot), F.pmod(F.xxhash64("rk"), F.lit(salts)).cast("int")).otherwise(0)
    rows = docs.select(F.col(id_col).alias("id"), squeezed(text_or_empty(text_col)).alias("norm")).withColumn("rk", F.monotonically_increasing_id())
    keyed = rows.withColumns({"h": F.xxhash64("norm"), "head": F.substring("norm", 1, prefix)}).withColumn("salt", salt).drop("rk")
    key = ["head", "h", "salt"] if hot else ["head", "h"]
    ranged = keyed.repartitionByRange(*key)
    # The range partitioning keeps a run in one task, so the windows need no further shuffle: Spark sorts by the
    # whole key and compares neighbours in full.
    order = Window.partitionBy(*key, "norm").orderBy(F.col("id").asc_nulls_last())
    run = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), F.col("id").alias("id"), F.col("salt").alias("salt")))
    return ranged.select(
        "id",
        F.sha2("norm", 256).alias("text_sha256"),
        "salt",
        F.col("h").isin(*hot).alias("salted") if hot else F.lit(False).alias("salted"),
        first.over(run).alias("run_first"),
        F.count(F.lit(1)).over(run).alias("run_size"),
        F.row_number().over(order).alias("nth"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, sample_rows: int = 20_000) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space; null counts as empty.
    Of equal texts the row with the smallest id stays. Null ids come after all others: in a group without
    any other, keep_id is null and one row stays. Of rows that repeat id and text one stays. An empty table
    gives an empty result; other columns aren't read.
    """
    runs = written(content_runs(docs, id_col, text_col, salts, sample_rows=sample_rows), "runs")
    merged = runs.where("salted AND nth = 1").groupBy(F.col("text_sha256").alias("of")).agg(F.min("run_first").alias("first"), F.sum("run_size").alias("size"))
    merged = written(merged, "salted")  # of known size for the join
    out = runs.join(merged, F.col("salted") & (F.col("text_sha256") == F.col("of")), "left")
    first = F.coalesce("first", "run_first")
    return out.select(
        F.col("id").alias(id_col),
        first["id"].alias("keep_id"),
        F.coalesce("size", "run_size").alias("group_size"),
        (F.col("id").eqNullSafe(first["id"]) & (F.col("salt") == first["salt"]) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )
