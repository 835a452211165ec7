"""Site-relative line deduplication: drops the lines that stand on too large a share of a host's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, text_or_empty, written


def line_key(line: Column) -> Column:
    """A line without white space at its ends, as 64 bits."""
    return F.xxhash64(F.btrim(line, F.lit(WS_CHARS)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 3, copies_once: bool = True) -> DataFrame:
    """host, bad: the keys of the lines that stand on more than ``ratio`` of the host's pages.

    A host's list has at most (mean distinct lines per page) / ratio keys. Pages count once per line, and
    counts are summed in each task before the shuffle. With ``copies_once`` the rows of a host with the same text
    are one page, for the lines and for the host's total: of each text only its lines' keys are shuffled, once a task.
    """
    pages = docs.select(F.col(host_col).alias("host"), text_or_empty(text_col).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(WS_CHARS)) != ""), line_key))
    pages = pages.select("host", F.xxhash64("text").alias("digest"), F.length("text").alias("size"), keys.alias("keys"))
    if copies_once:
        pages = pages.groupBy("host", "digest", "size").agg(F.first("keys").alias("keys"))
    # The page itself counts under a null key: one pass gives both the lines' pages and the host's total.
    each = pages.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.col("keys"))).alias("key"))
    counts = each.groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"))
    totals = counts.where("key IS NULL").select(F.col("host").alias("of"), F.col("pages").alias("total"))
    frequent = counts.where((F.col("key").isNotNull()) & (F.col("pages") >= min_pages))
    return (
        frequent.join(totals, F.col("host").eqNullSafe(F.col("of")))
        .where(F.col("pages") > F.lit(ratio) * F.col("total"))
        .groupBy("host")
        .agg(F.collect_set("key").alias("bad"))
    )


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 3, count_col: str | None = "n_lines_dropped", copies_once: bool = True) -> DataFrame:
    """docs with the boilerplate lines taken out of the text, and their number in ``count_col``.

    A line that stands on more than ``ratio`` of its host's pages, and on ``min_pages`` of them at least, is
    dropped from all of them; lines are compared without white space at their ends, and lines of white space
    stay. Rows of a host with the same text are one page, so that copies don't make their own text boilerplate;
    without ``copies_once`` each row is a page. Null hosts are one host. A null or empty text, or one that loses no line, stays as it is. All rows
    and columns stay, repeated ones too; a column named like ``count_col`` is replaced.
    """
    bad = written(boilerplate(docs, host_col, text_col, ratio, min_pages, copies_once), "boilerplate")
    # The lists' size is known from the files: Spark broadcasts them below its threshold, or shuffles.
    own = docs.select(F.struct("*").alias("doc"))
    joined = own.join(bad, F.col(f"doc.`{host_col}`").eqNullSafe(F.col("host")), "left")
    lines = _lines(F.col(f"doc.`{text_col}`"))
    good = F.when(F.col("bad").isNotNull(), F.filter(lines, lambda x: ~F.array_contains(F.col("bad"), line_key(x)) | (F.btrim(x, F.lit(WS_CHARS)) == "")))
    cut = joined.withColumn("good", good).withColumn("n", F.coalesce(F.size(lines) - F.size("good"), F.lit(0)))
    text = F.when(F.col("n") > 0, F.array_join("good", "\n")).otherwise(F.col(f"doc.`{text_col}`"))
    cols = [(text.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c)) for c in docs.columns if c != count_col]
    return cut.select(*cols, *([F.col("n").cast("long").alias(count_col)] if count_col else []))
