"""Which escape ends an entry: candidates by statistics over entry starts, scores by reading on from entry to entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decode import chains_cut
from .entries import MOST
from .runs import running_total
from .stored import written


def stride(df: DataFrame, by: list[str], order: str, step: int, trials: int | None = None) -> DataFrame:
    """Every step-th row of each group from the first on, the first ``trials`` of them. order: a unique number."""
    out = running_total(df, by, order, F.lit(1), "__n").where(F.col("__n") % step == 0)
    return (out.where(F.col("__n") < step * trials) if trials else out).drop("__n")


def sampled_starts(index: DataFrame, limit: int = 1200) -> DataFrame:
    """subbook, start: the first starts of each headword index, evenly, distinct. index: subbook, name, ord, start."""
    from .lookup import limited

    each = index.where(F.col("name").isin("word_asis", "word_kana", "word_alphabet"))
    names = each.select("subbook", "name").distinct().groupBy("subbook").agg(F.count(F.lit(1)).alias("n"))
    first = limited(each, ["subbook", "name"], limit).join(names, "subbook")
    return first.where(F.col("rank") <= F.floor(F.lit(limit) / F.col("n"))).select("subbook", "start").distinct()


def candidates(escapes: DataFrame, starts: int | None = None, least: float = 0.5) -> DataFrame:
    """subbook, code, argument, offset, share: escapes that stand at one offset of enough starts.

    escapes: subbook, start, offset, code, argument; a null code says that nothing stands there, and the start still counts.
    """
    total = escapes.groupBy("subbook").agg(F.countDistinct("start").alias("total"))
    each = escapes.where("code IS NOT NULL").groupBy("subbook", "code", "argument", "offset").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / (F.lit(starts) if starts else F.col("total"))
    return each.join(total, "subbook").withColumn("share", share).where(F.col("share") >= least).drop("total")


def in_order(found: DataFrame) -> DataFrame:
    """Candidates with ``nth``, their place in their subbook: by offset, then the more frequent first, then by code. They are few."""
    order = Window.partitionBy("subbook").orderBy("offset", F.desc("share"), "code", "argument")
    return found.withColumn("nth", F.row_number().over(order))


def prologue(starts: DataFrame) -> DataFrame:
    """The escapes around entry starts, as candidates() takes them. starts: subbook, start, bytes (twelve from four before the start on, or null)."""
    each = starts.select("subbook", "start", F.explode(F.array(*map(F.lit, (-4, 0, 4)))).alias("offset"), "bytes")
    four = F.hex(F.substring("bytes", F.col("offset") + 5, F.lit(4)))
    there = four.rlike("^1F(09|41)....$")
    number = lambda at: F.when(there, F.conv(F.substring(four, at, 4), 16, 10).cast("long"))
    return each.select("subbook", "start", "offset", number(1).alias("code"), number(5).alias("argument"))


def spread(starts: DataFrame, trials: int) -> DataFrame:
    """At most ``trials`` of each subbook's sampled starts, evenly. starts: subbook, start; a sample has a bounded number."""
    own = Window.partitionBy("subbook")
    n = F.count(F.lit(1)).over(own)
    nth = F.row_number().over(own.orderBy("start")) - 1
    step = F.greatest(F.lit(1), F.floor(n / trials))
    return starts.withColumns({"nth": nth, "step": step}).where("nth % step = 0 AND nth DIV step < " + str(int(trials))).select("subbook", "start")


def followed(candidates: DataFrame, seeds: DataFrame, known: DataFrame, shapes: DataFrame, fetch: Callable[[DataFrame, int], DataFrame], depth: int = 25) -> DataFrame:
    """subbook, code, argument, offset, start, good: chained(), with entries read from their bytes.

    known: subbook, start; shapes: subbook, shape, all of one length in a subbook: a place is an entry's start if it is known or
    begins with a shape. fetch gives subbook, start and so many bytes for places (subbook, start). A round reads each chain as far as its bytes
    go, keeps it up to its first bad read, and is written; the next goes on where bytes were lacking. There are seeds times candidates chains.
    """
    key = ["subbook", "code", "argument", "offset"]
    marks = known.select("subbook", F.col("start").alias("to"), F.lit(True).alias("known")).distinct()
    shapes = shapes.select("subbook", "shape", F.octet_length("shape").alias("width"))
    widths = shapes.groupBy("subbook").agg(F.max("width").alias("width"))
    ahead = candidates.select(*key).join(seeds.select("subbook", "start").distinct(), "subbook").withColumn("left", F.lit(int(depth)).cast("long"))
    ahead = written(ahead, "ahead")
    reads = met = None
    while not ahead.isEmpty():
        rows = ahead.join(fetch(ahead.select("subbook", "start").distinct(), MOST), ["subbook", "start"]).join(widths, "subbook", "left")
        rows = rows.withColumns({"ends": F.col("code") * 65536 + F.col("argument"), "width": F.coalesce("width", F.lit(0)), "begin": F.col("start")})
        cut = written(chains_cut(rows).select(*key, "begin", "reads", "resume"), "cut")
        each = cut.select(*key, "begin", F.posexplode("reads").alias("nth", "r")).select(*key, "begin", "nth", "r.start", "r.to", "r.shape")
        each = each.join(marks, ["subbook", "to"], "left").join(shapes.select("subbook", "shape", F.lit(True).alias("fits")), ["subbook", "shape"], "left")
        each = written(each.select(*key, "begin", "nth", "start", F.coalesce("known", "fits", F.lit(False)).alias("good")), "reads")
        bad = each.where("NOT good").groupBy(*key, "begin").agg(F.min("nth").alias("bad"))
        own = each.join(bad, [*key, "begin"], "left").where("bad IS NULL OR nth <= bad").select(*key, "start", "good")
        reads = own if reads is None else reads.unionByName(own)
        done = ahead.select(*key, "start")
        met = done if met is None else met.unionByName(done)
        rest = cut.where("resume IS NOT NULL").join(bad, [*key, "begin"], "left_anti").select(*key, "resume.start", "resume.left")
        ahead = written(rest.groupBy(*key, "start").agg(F.max("left").alias("left")).join(met, [*key, "start"], "left_anti"), "ahead")
    return reads.distinct() if reads is not None else ahead.select(*key, "start", F.lit(True).alias("good"))


def signatures(shapes: DataFrame) -> DataFrame:
    """subbook, shape, n: shapes of entry starts that are frequent enough: twice, and one start in 200. shapes: subbook, start, shape."""
    total = shapes.groupBy("subbook").agg(F.count(F.lit(1)).alias("total"))
    each = shapes.groupBy("subbook", "shape").agg(F.count(F.lit(1)).alias("n"))
    return each.join(total, "subbook").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("total") / 200))).drop("total")


def scored(reads: DataFrame) -> DataFrame:
    """A candidate's score: how many of its reads end where an entry begins. reads: subbook, code, argument, offset, good."""
    good = F.sum(F.col("good").cast("int"))
    return reads.groupBy("subbook", "code", "argument", "offset").agg((good / F.count(F.lit(1))).alias("score"))


def chosen(scores: DataFrame, tie: float = 0.03, least: float = 0.5) -> DataFrame:
    """subbook, code, argument, offset, score: the smallest offset among the best, within the tie; none below ``least``."""
    top = scores.groupBy("subbook").agg(F.max("score").alias("top")).where(F.col("top") >= least)
    near = scores.join(top, "subbook").where(F.col("score") >= F.col("top") - tie)
    first = near.groupBy("subbook").agg(F.min(F.struct("offset", (-F.col("score")).alias("minus"), "code", "argument", "score")).alias("x"))
    return first.select("subbook", "x.code", "x.argument", "x.offset", "x.score")


def chained(seeds: DataFrame, nexts: DataFrame, known: DataFrame, depth: int = 25) -> DataFrame:
    """subbook, code, argument, offset, start, good: what is read when each candidate is followed from entry to entry.

    seeds: subbook, start. nexts: subbook, code, argument, offset, start, next, where ``next`` begins what follows the
    entry at ``start`` if that candidate ends it. known: subbook, start, of entries. A read is good where the
    next is known; a chain ends after a bad one or ``depth`` reads, and a place that several chains meet
    counts once. A step is one join, written before the next, so that rows have no limit.
    """
    there = known.select("subbook", F.col("start").alias("next")).distinct().withColumn("good", F.lit(True))
    marked = nexts.join(there, ["subbook", "next"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    steps = written(marked.select("subbook", "code", "argument", "offset", "start", "next", "good").distinct(), "steps")
    reads = written(steps.join(seeds.select("subbook", "start").distinct(), ["subbook", "start"]).select(steps.columns), "chain")
    found = reads
    for _ in range(int(depth) - 1):
        ahead = reads.where("good").select("subbook", "code", "argument", "offset", F.col("next").alias("start")).distinct()
        reads = written(steps.join(ahead, ["subbook", "code", "argument", "offset", "start"]).select(steps.columns), "chain")
        if reads.isEmpty():
            break
        found = found.unionByName(reads)
    return found.select("subbook", "code", "argument", "offset", "start", "good").distinct()
