"""Hard negatives by an orthogonal PCA rotation: partial inner products bound the rest, survivors are multiplied whole.

All vectors are turned by the eigenvectors of their second moments, which leaves inner products as they are and puts
most of them into the leading components. The product of the leading components and the norms of the rest bound a
score from both sides; what can't reach a row's range or its best is left out early. Survivors get their score from the
whole numbers alone, so rounding never decides: the bounds have a slack for it.

Vectors are packed into blocks, anchors into blocks of their own, and each block of anchors meets each block of
vectors by its number. A pair of blocks gives an anchor's best few rows; the best of all blocks are Spark's to rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Leading components that are multiplied before each look at the bounds.
STAGES = (16, 32)
BLOCK = "first long, n int, dim int, ids binary, no_id binary, labels binary, ints binary, most double"
ANCHOR = "rk long, vec_id long, label long, dim int, ints binary"


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite values. One beyond 64 bits is an error: its scores wouldn't fit a long."""
    out = np.floor(values.astype(np.float64) * 256)
    if len(out) and np.abs(out).max() >= 2.0**62:
        raise ArithmeticError("a component is too large for whole-number scores")
    return out.astype(np.int64)


def exact(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise inner products of whole numbers; beyond 64 bits they are an error."""
    if not a.size:
        return np.zeros(len(a), np.int64)
    if float(np.abs(a).max()) * float(np.abs(v).max()) * a.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", a, v)
    return np.array([sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a, v)], dtype=np.int64)


def blocks(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, rows: int = 8192, shift: int | None = 7, labels: int = 10) -> DataFrame:
    """Rows that take part, packed by label into blocks, written. A row's number is ``first`` plus its place.

    ``shift``: labels of ids that it divides become the next of ``labels`` labels first.
    """
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("label IS NOT NULL AND v IS NOT NULL")

    def packed(first: int, rows: list[tuple]) -> tuple:
        rows.sort(key=lambda r: r[1])
        dim = max(len(r[2]) for r in rows)
        ints = np.zeros((len(rows), dim), np.int64)
        for i, r in enumerate(rows):
            ints[i, : len(r[2])] = r[2]
        ids = np.array([r[0] or 0 for r in rows], np.int64)
        return first, len(rows), dim, ids.tobytes(), np.array([r[0] is None for r in rows]).tobytes(), np.array([r[1] for r in rows], np.int64).tobytes(), ints.tobytes(), float(np.abs(ints).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held = TaskContext.get().partitionId() << 40, []

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(packed(first, held), kinds)], names=[f.split()[0] for f in BLOCK.split(", ")])

        for b in batches:
            flat = b.column(2).flatten()
            at = np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))])
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0).to_numpy(zero_copy_only=False)
            fine = known & np.isfinite(values)
            ints = whole_numbers(np.where(fine, values, 0))
            for i, (vec_id, label) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if fine[at[i] : at[i + 1]].all():
                    if shift and vec_id is not None and vec_id % shift == 0:
                        label = (label + 1) % labels
                    held.append((vec_id, label, ints[at[i] : at[i + 1]]))
                    if len(held) == rows:
                        yield out()
                        first, held = first + len(held), []
        if held:
            yield out()

    return written(plain.mapInArrow(run, BLOCK), "blocks")


class Rows:
    """A block's rows as arrays."""

    def __init__(self, n: int, dim: int, ids: bytes, no_id: bytes, labels: bytes, ints: bytes, first: int = 0):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.no_id = np.frombuffer(no_id, bool)
        self.ints = np.frombuffer(ints, np.int64).reshape(n, dim)
        self.rk = first + np.arange(n)


def second_moments(packed: DataFrame, dim: int) -> np.ndarray:
    """Sums of products of components over all rows. Of each task one matrix, whose size is the vectors' alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            for n, d, ints in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(ints, np.int64).reshape(n, d).astype(np.float64)
                total[:d, :d] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    cells = packed.select("n", "dim", "ints").mapInArrow(run, "i int, sums array<double>").select("i", F.posexplode("sums").alias("j", "s"))
    out = np.zeros((dim, dim))
    for r in cells.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # the square of the vectors' length
        out[r.i, r.j] = r.s
    return out


def rotation(packed: DataFrame, dim: int) -> np.ndarray:
    """The eigenvectors of the second moments, those of the largest first, as columns."""
    moments = second_moments(packed, dim)
    scale = np.abs(moments).max(initial=0)
    return np.linalg.eigh(moments / scale if scale > 0 else moments)[1][:, ::-1].copy()


class Turned:
    """Rows in rotated components, with the norms of what follows each stage."""

    def __init__(self, ints: np.ndarray, turn: np.ndarray, stages: tuple[int, ...]):
        dim = len(turn)
        self.ints = np.zeros((len(ints), dim), np.int64)
        self.ints[:, : ints.shape[1]] = ints
        plain = self.ints.astype(np.float64)
        self.y = plain @ turn
        self.norm = np.sqrt((plain**2).sum(axis=1))
        self.top = float(np.abs(self.ints).max(initial=0))
        self.rest = {k: np.sqrt((self.y[:, k:] ** 2).sum(axis=1)) for k in stages}


def products(a: Turned, v: Turned) -> np.ndarray | None:
    """All inner products of whole numbers, as doubles that hold them exactly; none where doubles don't."""
    if a.top * v.top * max(1, a.ints.shape[1]) >= 2.0**53:
        return None
    return a.ints.astype(np.float64) @ v.ints.T.astype(np.float64)


def first_ones(i: np.ndarray, j: np.ndarray, score: np.ndarray, most: int, ids: np.ndarray, no_id: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``most`` best of each i: higher scores first, then smaller ids, no ids last."""
    order = np.lexsort((j, ids[j], no_id[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[first], j[first], score[first]


def floor_of(values: np.ndarray, low: np.ndarray, most: int) -> np.ndarray:
    """A row's ``most``-th largest value, or its low end: nothing below can be among its best."""
    if values.shape[1] <= most:
        return low.astype(np.float64)
    at = values.shape[1] - most
    return np.maximum(low, np.partition(values, at, axis=1)[:, at])


def best(a: Turned, v: Turned, allowed: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]], most: int, ids: np.ndarray, no_id: np.ndarray, stages: tuple[int, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each range (low, high of each a): places i, j and scores of each a's ``most`` best allowed rows of v in the range.

    After each stage of leading components the rows whose bounds miss all ranges, or stay below a range's best, are left
    out. If few are left they go on as pairs; where the components don't say much, all products are taken at once.
    """
    slack = 256 * max(a.y.shape[1], 1) * 2.0**-52
    part, done, live = np.zeros(allowed.shape), 0, None
    for k in stages:
        part = part + a.y[:, done:k] @ v.y[:, done:k].T
        reach = a.rest[k][:, None] * v.rest[k][None, :] + slack * a.norm[:, None] * v.norm[None, :]
        up, down, done = part + reach, part - reach, k
        widest = np.minimum.reduce([low for low, _ in ranges]), np.maximum.reduce([high for _, high in ranges])
        rough = allowed & (up >= widest[0][:, None]) & (down <= widest[1][:, None])
        # The ranges' own bests are only worth finding where many bounds are narrow.
        if rough.sum() * 4 < rough.size or np.median(reach) * 4 < np.ptp(part):
            keeps, floors = [], []
            for low, high in ranges:
                sure = np.where(rough & (down >= low[:, None]) & (up <= high[:, None]), down, -np.inf)
                floors.append(floor_of(sure, low, most))
                keeps.append(rough & (up >= floors[-1][:, None]) & (down <= high[:, None]))
            rough = np.logical_or.reduce(keeps)
            if rough.sum() * 4 < rough.size:
                live = np.nonzero(rough)
                break
        allowed = rough
    whole = None if live is not None else products(a, v)
    if whole is not None:
        for low, high in ranges:
            inside = np.where(allowed & (whole >= low[:, None]) & (whole <= high[:, None]), whole, -np.inf)
            i, j = np.nonzero(inside >= np.maximum(floor_of(inside, low, most), -(2.0**53))[:, None])
            yield first_ones(i, j, whole[i, j].astype(np.int64), most, ids, no_id)
        return
    i, j = live if live is not None else np.nonzero(allowed)
    if live is not None:
        part = part[i, j]
        for k in (x for x in stages if x > done):
            part = part + np.einsum("ij,ij->i", a.y[i, done:k], v.y[j, done:k])
            reach = a.rest[k][i] * v.rest[k][j] + slack * a.norm[i] * v.norm[j]
            keep = np.logical_or.reduce([(part + reach >= floor[i]) & (part - reach <= high[i]) for floor, (_, high) in zip(floors, ranges)])
            i, j, part, done = i[keep], j[keep], part[keep], k
    score = np.concatenate([np.zeros(0, np.int64), *(exact(a.ints[i[c : c + 65536]], v.ints[j[c : c + 65536]]) for c in range(0, len(i), 65536))])
    for low, high in ranges:
        at = (score >= low[i]) & (score <= high[i])
        yield first_ones(i[at], j[at], score[at], most, ids, no_id)


def anchors_of(packed: DataFrame, every: int) -> DataFrame:
    """The rows whose id ``every`` divides, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows = Rows(r["n"], r["dim"], r["ids"], r["no_id"], r["labels"], r["ints"], r["first"])
                at = np.flatnonzero(~rows.no_id & (rows.ids % every == 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.rk[at]), pa.array(rows.ids[at]), pa.array(rows.labels[at]), pa.array(np.full(len(at), r["dim"], np.int32)), pa.array([rows.ints[i].tobytes() for i in at], pa.binary())],
                    names=["rk", "vec_id", "label", "dim", "ints"],
                )

    return packed.mapInArrow(run, ANCHOR)


def met(anchors: DataFrame, packed: DataFrame, group: int = 512) -> DataFrame:
    """Each block of anchors with each block of vectors. Blocks meet by number, in rows of bounded size.

    anchors: rk, label, dim, ints, low and high (arrays, one range for each search).
    """
    n = max(1, -(-anchors.count() // group))
    dealt = anchors.withColumn("ab", F.pmod(F.xxhash64("rk"), F.lit(n)))
    asked = written(dealt.groupBy("ab").agg(F.collect_list(F.struct("rk", "label", "dim", "ints", "low", "high")).alias("anchors")), "anchors")
    numbers = packed.select("first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("ab"))
    return numbers.join(asked, "ab").join(packed, "first")


def searched(pairs: DataFrame, turn: np.ndarray, same: bool, most: int, stages: tuple[int, ...] = STAGES, part: int = 128) -> DataFrame:
    """rk, nth (number of the range), row, vec_id, score: the best of each block for each anchor and range."""
    stages = tuple(k for k in stages if k < len(turn)) or (len(turn),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                if r["first"] != name:
                    rows = Rows(r["n"], r["dim"], r["ids"], r["no_id"], r["labels"], r["ints"], r["first"])
                    name, held = r["first"], Turned(rows.ints, turn, stages)
                asked = sorted(r["anchors"], key=lambda x: x["label"])
                for cut in range(0, len(asked), part):
                    some = asked[cut : cut + part]
                    ints = np.zeros((len(some), len(turn)), np.int64)
                    for i, x in enumerate(some):
                        ints[i, : x["dim"]] = np.frombuffer(x["ints"], np.int64)
                    a = Turned(ints, turn, stages)
                    equal = np.array([x["label"] for x in some])[:, None] == rows.labels[None, :]
                    allowed = equal & (np.array([x["rk"] for x in some])[:, None] != rows.rk[None, :]) if same else ~equal
                    n = max((len(x["low"]) for x in some), default=0)
                    # An anchor with fewer ranges than others has empty ones.
                    end = lambda x, name, nth, none: x[name][nth] if nth < len(x[name]) else none
                    ranges = [tuple(np.array([end(x, name, nth, none) for x in some], np.int64) for name, none in (("low", 2**62), ("high", -(2**62)))) for nth in range(n)]
                    for nth, (i, j, score) in enumerate(best(a, held, allowed, ranges, most, rows.ids, rows.no_id, stages)):
                        rk = np.array([x["rk"] for x in some], np.int64)[i]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rk), pa.array(np.full(len(i), nth, np.int32)), pa.array(rows.rk[j]), pa.array(rows.ids[j], mask=rows.no_id[j]), pa.array(score)],
                            names=["rk", "nth", "row", "vec_id", "score"],
                        )

    return pairs.mapInArrow(run, "rk long, nth int, row long, vec_id long, score long")


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each anchor and range, numbered from 1."""
    order = Window.partitionBy("rk", "nth").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, shift: int | None = 7, labels: int = 10, block_rows: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x becomes floor(256 x); a score is the inner product of these whole numbers. Anchors are the rows whose
    id ``every`` divides; an anchor's positives are its best ``positives`` other rows of its label. For each, the best
    ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the positive's are returned;
    none where the positive's score is negative. Higher scores come first, then smaller ids, null ids last.

    Rows with a null label or vector, or with a null or non-finite component take no part. Rows with a null id are no
    anchors. Rows that repeat an id are rows of their own: each may be an anchor, or a positive of the other. A shorter
    vector counts as one with zeros at its end. Scores must fit a long, else it is an error. An anchor without
    positives or negatives gives no row, an empty table none. Other columns aren't read.
    """
    packed = blocks(vectors, id_col, label_col, vector_col, block_rows, shift, labels)
    dim = packed.agg(F.max("dim")).first()[0] or 0
    turn = rotation(packed, dim)
    anchors = written(anchors_of(packed, every), "anchor-rows")
    wide = lambda v: F.array(F.lit(v).cast("long"))
    near = searched(met(anchors.withColumns({"low": wide(-(2**62)), "high": wide(2**62)}), packed), turn, True, positives)
    good = written(ranked(near, positives).select("rk", F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 30 p <= 100 s <= 90 p in whole numbers; a range with its low end above its high end is empty.
    bounds = good.groupBy("rk").agg(F.sort_array(F.collect_list(F.struct("p", "positive_score"))).alias("s"))
    ends = bounds.select("rk", F.expr(f"transform(s, x -> -((-{low} * x.positive_score - pmod(-{low} * x.positive_score, 100)) div 100))").alias("low"), F.expr(f"transform(s, x -> ({high} * x.positive_score - pmod({high} * x.positive_score, 100)) div 100)").alias("high"))
    far = searched(met(anchors.join(ends, "rk"), packed), turn, False, negatives)
    out = ranked(far, negatives).join(good.withColumn("nth", F.col("p") - 1), ["rk", "nth"]).join(anchors.select("rk", F.col("vec_id").alias("anchor_id")), "rk")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
