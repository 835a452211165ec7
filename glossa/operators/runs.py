"""Ordered-state operators in two levels: within bounded chunks of the order, then over the chunks.

A plain window over a large group would put the whole group in one task. Here an order number is cut into
chunks of ``chunk`` numbers; each chunk is summed up, the sums are carried over the chunks, and
the rows of each chunk are finished by a window over that chunk alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn("__chunk", F.floor(F.col(order) / chunk))


def _keys(by: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    on = left["__chunk"] == right["__chunk"]
    for k in by:
        on = on & left[k].eqNullSafe(right[k])
    return on


def carried(df: DataFrame, by: Sequence[str], order: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with the last non-null value up to each row of its group, however far back it stands."""
    rows = _chunked(df, order, chunk).withColumn("__v", value)
    # max_by skips nothing by itself: rows without a value are filtered first.
    ends = rows.groupBy(*by, "__chunk").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))).alias("__end"))
    before = F.last("__end", True).over(Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*by, "__chunk", before.alias("__before"))
    inside = F.last("__v", True).over(Window.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.join(ends, _keys(by, rows, ends), "left").select(rows["*"], ends["__before"])
    return joined.withColumn(name, F.coalesce(inside, "__before")).drop("__chunk", "__v", "__before")


def running_total(df: DataFrame, by: Sequence[str], order: str, amount: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with the sum of the amounts before each row of its group, in the order of a unique number."""
    rows = _chunked(df, order, chunk).withColumn("__v", amount)
    sums = rows.groupBy(*by, "__chunk").agg(F.sum("__v").alias("__sum"))
    over = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__chunk", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__before"))
    own = Window.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sums, _keys(by, rows, sums), "left").select(rows["*"], sums["__before"])
    return joined.withColumn(name, F.col("__before") + F.coalesce(F.sum("__v").over(own), F.lit(0))).drop("__chunk", "__v", "__before")


def grouped_entries(entries: DataFrame, by: Sequence[str], order: str = "ord", chunk: int = CHUNK) -> DataFrame:
    """Members of a grouped index with their header's key in ``group_key``.

    kind: single, header or member. A single entry ends a group: members after it have no header, so the last
    row that is no member is what is carried, over page borders and chunks alike.
    """
    head = F.when(F.col("kind") == "header", F.col("key")).when(F.col("kind") == "single", F.lit("\x00none"))
    out = carried(entries, by, order, head, "group_key", chunk)
    member = F.col("kind") == "member"
    return out.withColumn("group_key", F.when(member & (F.col("group_key") != "\x00none"), F.col("group_key")).when(F.col("kind") == "header", F.col("key")))


def next_different(runs: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Rows with the order number of the next row whose value differs, round the end of the group; null if none does.

    For lists that people page through: a group here is one result list, which its limit keeps short.
    """
    w = Window.partitionBy(*by).orderBy(order)
    last_of_run = F.lead(value).over(w).isNull() | (F.lead(value).over(w) != F.col(value))
    after = F.lead(order).over(w)
    marked = runs.withColumn("__next", F.when(last_of_run, F.coalesce(after, F.lit(-1).cast("long"))))
    ahead = F.first("__next", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy(*by)
    firsts = marked.withColumn("__ahead", ahead).withColumn("__first", F.min(F.struct(order, value)).over(whole))
    around = F.when(F.col("__first")[value] != F.col(value), F.col("__first")[order])
    # From the last run round the end: the first row differs, or the list begins and ends with one value.
    second = F.min(F.when(F.col(value) != F.col("__first")[value], F.col(order))).over(whole)
    out = F.when(F.col("__ahead") >= 0, F.col("__ahead")).otherwise(F.coalesce(around, second))
    return firsts.withColumn(name, out).drop("__next", "__ahead", "__first")
