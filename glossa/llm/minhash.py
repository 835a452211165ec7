"""Near-duplicates by circulant MinHash.

Two permutations of a universe of cells make all coordinates of a signature: the first spreads a document's
shingles over the cells, the second, shifted circularly by k places, gives coordinate k as the least value on
the document's cells. Bands of coordinates name candidates, and links are confirmed by the exact Jaccard
similarity of the full shingle sets.

Documents with equal sets are one class. In each bucket the members are compared with one lead. Where a bucket
still has members of several components, rounds with a new lead, from the bucket's largest component, go on as
long as they bring many components together; each round is linear in the members. What is then still apart
meets under its rarest shingles, exactly: only pairs of different components, of fitting sizes, and at places
in their orders of shingles that leave enough to share. No candidate that could join two components is left out.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import written
from .components import merged

K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class Shingles:
    """Shingle sets of whole texts as sorted arrays of 64-bit hashes; hashes of words are cached, up to ``limit``."""

    def __init__(self, size: int = 2, limit: int = 500_000):
        import xxhash

        self.size, self.limit, self.hash = size, limit, xxhash.xxh3_64_intdigest
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        # lower() and split() of bytes know A-Z and the white space space, \t to \r alone.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = self.hash(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = max(1, len(h) - self.size + 1)
        out = np.full(n, K3 ^ np.uint64(min(len(h), self.size)))
        for i in range(min(self.size, len(h))):
            out = (out ^ (h[i : i + n] * K1)) * K2
            out ^= out >> np.uint64(29)
        return np.unique(out)


class Circulant:
    """Signatures and band keys of shingle sets."""

    def __init__(self, bands: int = 48, rows: int = 6, bits: int = 20, seed: int = 11):
        draw = np.random.default_rng(seed)
        size, self.k = 1 << bits, bands * rows
        self.bands, self.rows, self.mask = bands, rows, np.uint64(size - 1)
        self.spread = draw.permutation(size).astype(np.int32)
        order = draw.permutation(size).astype(np.int32)
        # Row j of the view: the second permutation at places j, j - 1, ..., round the end, in reverse.
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([order[1 - self.k :], order]), self.k)
        self.primes = draw.integers(1, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.number = draw.integers(0, 1 << 63, bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        cells = np.unique(self.spread[(shingles & self.mask).astype(np.int64)])
        out = None
        for at in range(0, len(cells), 2048):
            low = self.shifted[cells[at : at + 2048]].min(axis=0)
            out = low if out is None else np.minimum(out, low)
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        coords = self.signature(shingles).astype(np.uint64).reshape(self.bands, self.rows)
        h = ((coords + np.uint64(1)) * self.primes).sum(axis=1, dtype=np.uint64) ^ self.number
        h = (h ^ (h >> np.uint64(32))) * K1
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, bands: int = 48, rows: int = 6) -> DataFrame:
    """row (a struct of docs' columns), rk (a number for each row), n (set size), set (digest of the set) and bands, written."""
    numbered = docs.select(F.struct("*").alias("row")).withColumn("rk", F.monotonically_increasing_id())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sets, sign = Shingles(shingle), Circulant(bands, rows)
        for b in batches:
            n, digest, keys, ends = [], [], [], [0]
            for text in b.column(0).field(at).to_pylist():
                s = sets(text)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    keys.append(sign.keys(s))
                ends.append(ends[-1] + bands * bool(len(s)))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], names=["row", "rk", "n", "set", "bands"])

    schema = StructType([*numbered.schema.fields]).add("n", "long").add("set", "binary").add("bands", ArrayType(LongType()))
    return written(numbered.mapInArrow(run, schema), "signed")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs a, b whose full sets have 100 * intersection >= percent * union. texts: rk, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles(shingle)
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(rk: int, text: str) -> np.ndarray:
            if (s := held.get(rk)) is None:
                held[rk] = s = sets(text)
                if len(held) > 64:
                    held.popitem(last=False)
            return s

        for b in batches:
            keep = []
            for i, j, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p, q = of(i, x), of(j, y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("rk").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    with_b = with_a.join(texts.select(F.col("rk").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def rarest_shingles(nodes: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """node, n, part, key and place: each node's rarest shingles, as many as a link needs to share one of.

    Two sets of at least that similarity have one in common among the n - ceil(n * percent / 100) + 1 that come
    first in any one order; here the order is that of the number of nodes. Passages that many texts share come
    last, and bring no texts together that share little else. nodes: node, n, part; those that stand alone
    with a shingle come before all others and need no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles(shingle)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                c = b.slice(at, 200)
                each = [sets(t).view(np.int64) for t in c.column(3).to_pylist()]
                ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))
                yield pa.RecordBatch.from_arrays([*c.columns[:3], keys], names=["node", "n", "part", "keys"])

    full = nodes.join(texts.withColumnRenamed("rk", "node"), "node").select("node", "n", "part", "text")
    rows = written(full.mapInArrow(run, "node long, n long, part long, keys array<bigint>"), "shingles")
    each = rows.select("node", "n", "part", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rated = each.join(shared, "key")
    by = Window.partitionBy("node")
    shared_n = F.count(F.lit(1)).over(by)
    place = F.col("n") - shared_n + F.row_number().over(by.orderBy("df", "key"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return rated.withColumn("place", place).where(F.col("place") <= first).select("node", "n", "part", "key", "place")


def fits(percent: int, n: str = "n", m: str = "m") -> Column:
    """The smaller set can't be less than that share of the larger one."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def led_pairs(buckets: DataFrame, parts: DataFrame, percent: int, turn: int) -> DataFrame:
    """a, b: in each bucket with several components, a lead of the largest one and each member of the others.

    One row for each such member of a bucket at most; the lead is chosen by a hash of the turn and the bucket.
    """
    placed = buckets.join(parts, "node").select("key", "node", "n", F.col("label").alias("part"))
    lead = F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("h"), F.col("node").alias("a"), F.col("n").alias("m")))
    each = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"), lead.alias("lead"))
    leads = each.groupBy("key").agg(F.count(F.lit(1)).alias("n_parts"), F.max(F.struct("size", "part", "lead")).alias("x")).where("n_parts > 1")
    leads = written(leads.select("key", F.col("x.part").alias("of"), F.col("x.lead.a").alias("a"), F.col("x.lead.m").alias("m")), "leads")
    pairs = placed.join(leads, "key").where((F.col("part") != F.col("of")) & fits(percent))
    return pairs.select("a", F.col("node").alias("b")).distinct()


def apart_pairs(rare: DataFrame, percent: int, step: float = 1.1) -> DataFrame:
    """a, b: the nodes of different components that can be linked by what their rarest shingles leave open.

    rare: as rarest_shingles() gives it, written. Under a shingle that several components share, rows of all
    but its largest component look for partners, so that members of one component never meet. A row looks in
    those classes of size only in which its place leaves enough to share with the smallest set of the class.
    """
    each = rare.groupBy("key", "part").agg(F.count(F.lit(1)).alias("size"))
    keys = each.groupBy("key").agg(F.count(F.lit(1)).alias("n_parts"), F.max(F.struct("size", "part")).alias("x")).where("n_parts > 1")
    keys = written(keys.select("key", F.col("x.part").alias("major")), "keys")
    met = written(rare.join(keys, "key"), "met")
    size_class = lambda n: F.floor(F.log(n) / float(np.log(step)) + 1e-9)
    left = met.where("part <> major").select("key", F.col("node").alias("x"), "n", F.col("part").alias("part_x"), F.col("place").alias("i"))
    left = left.withColumn("class", F.explode(F.sequence(size_class(F.ceil(F.col("n") * percent / 100)), size_class(F.floor(F.col("n") * 100 / percent)))))
    least_m = F.greatest(F.pow(F.lit(step), F.col("class")) - 1e-6, F.col("n") * percent / 100)
    left = left.where(F.lit(100 + percent) * (1 + F.col("n") - F.col("i")) >= F.lit(percent) * (F.col("n") + least_m) - 1e-3)
    right = met.select("key", size_class(F.col("n")).alias("class"), F.col("node").alias("y"), F.col("n").alias("m"), F.col("part").alias("part_y"), "major", F.col("place").alias("j"))
    # A link's first common shingle, in the order of places, leaves at most the rest of either set to share.
    in_reach = F.lit(100 + percent) * (1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))) >= F.lit(percent) * (F.col("n") + F.col("m"))
    once = (F.col("part_y") == F.col("major")) | (F.col("x") < F.col("y"))
    pairs = left.join(right, ["key", "class"]).where((F.col("part_x") != F.col("part_y")) & once & fits(percent) & in_reach)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def labelled(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 2, bands: int = 48, rows: int = 6, turns: int = 6
) -> DataFrame:
    """row (a struct of docs' columns), n (set size), component_id and kept: one kept row in each component.

    component_id is the smallest id reachable over links; null ids come after all others. Texts without
    words (null ones too) have empty sets and are components of their own. With the default bands a link at
    similarity 0.8 is missed as a candidate with probability (1 - 0.8^6)^48, about 5 in ten million. turns:
    the most rounds with leads; what they leave apart is found exactly whatever their number.
    """
    store = signed(docs, id_col, text_col, shingle, bands, rows)
    own_id = F.col("row").getField(id_col)
    own = F.struct(own_id.isNull().alias("missing"), own_id.alias("id"), F.col("rk").alias("rk"))
    classes = store.where("n > 0").groupBy("set").agg(F.min(own).alias("first"), F.min(F.struct("rk", "n", "bands")).alias("x"))
    classes = written(classes.select("set", "first", F.col("x.rk").alias("node"), F.col("x.n").alias("n"), F.col("x.bands").alias("bands")), "classes")

    members = classes.select("node", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min(F.struct(F.col("node").alias("a"), F.col("n").alias("m"))).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = written(members.join(buckets.select("key", "lead"), "key"), "buckets")
    parts = written(buckets.select("node").distinct().withColumn("label", F.col("node")), "parts")
    texts = store.select("rk", F.col("row").getField(text_col).alias("text")).join(parts.select(F.col("node").alias("rk")).hint("merge"), "rk")
    texts = written(texts, "texts")

    pairs = written(buckets.select("node", "n", "lead.*").where((F.col("node") != F.col("a")) & fits(percent)).select("a", F.col("node").alias("b")).distinct(), "pairs")
    for turn in range(1, turns + 1):
        links = written(confirmed(pairs, texts, percent, shingle), "links")
        before, parts = parts, merged(parts, links)
        gone = before.select("label").distinct().count() - parts.select("label").distinct().count()
        pairs = written(led_pairs(buckets, parts, percent, turn), "pairs")
        if turn > 1 and 20 * gone < pairs.select("b").distinct().count() or pairs.isEmpty():
            break

    if not pairs.isEmpty():
        placed = buckets.join(parts, "node").select("key", "node", "n", F.col("label").alias("part"))
        mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
        mixed = written(placed.join(mixed, "key").select("node", "n", "part").distinct(), "mixed")
        rare = written(rarest_shingles(mixed, texts, percent, shingle), "rare")
        pairs = written(apart_pairs(rare, percent), "pairs")
        parts = merged(parts, written(confirmed(pairs, texts, percent, shingle), "links"))

    nodes = classes.select("set", "first", "node").join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = written(nodes.select("set", "first", "label"), "nodes")
    heads = written(nodes.groupBy("label").agg(F.min("first").alias("head")), "heads")
    named = written(nodes.join(heads, "label").select(F.col("set").alias("of"), F.col("head.id").alias("component_id"), F.col("head.rk").alias("head")), "named")
    kept = F.when(F.col("of").isNull(), True).otherwise(F.col("rk") == F.col("head"))
    # Sort-merge joins at every size: what is joined to the texts grows with them and must not be broadcast.
    out = store.drop("bands").join(named.hint("merge"), F.col("set") == F.col("of"), "left")
    return out.select("row", "n", F.when(F.col("of").isNull(), own_id).otherwise(F.col("component_id")).alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (id = component_id). See labelled().

    Rows that repeat an id and its text share a component. An empty table gives an empty result; other
    columns aren't read.
    """
    own_id = F.col("row").getField(id_col)
    named = labelled(docs.select(id_col, text_col), id_col, text_col, **how)
    return named.select(own_id.alias(id_col), F.col("n").alias("n_shingles"), "component_id", own_id.eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each component, that with the smallest id, and all columns, whatever their names."""
    return labelled(docs, id_col, text_col, **how).where("kept").select("row.*")
