"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are cut into bins. Boosting goes round the features in turn, and each time fits a
shallow tree on one feature's bins to what is left unexplained; the pairs of features that explain most of
the rest get shallow trees on two features in the same way. The trees add up to lookup tables per feature and pair,
and a text's score is a sum of table entries, looked up for a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import Measures

DIGITS = bytes(range(48, 58))
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
NAMES = ("log_words", "word_length", "symbols", "capitals", "repeated_lines", "repetition", "digits", "punctuation", "words_per_line", "distinct_words", "top_word", "words_per_stop", "non_ascii")


def features(text: str | None) -> list[float]:
    """Figures of one whole text; an empty one has zeros. No label, language, source or id is read."""
    m = Measures(text)
    n, size = max(1, m.n_words), max(1, len(m.raw))
    distinct: dict[bytes, int] = {}
    for w in m.words:
        distinct[w] = distinct.get(w, 0) + 1
    count = lambda chars: size - len(m.raw.translate(None, chars)) if m.raw else 0
    return [
        float(np.log1p(m.n_words)),
        m.word_chars / n,
        m.n_symbols / n,
        m.n_upper / max(1, m.n_upper + m.n_lower),
        m.n_dup_lines / max(1, m.n_lines),
        m.n_repeat_words / n,
        count(DIGITS) / size,
        count(PUNCTUATION) / n,
        m.n_words / max(1, m.n_lines),
        len(distinct) / n,
        max(distinct.values(), default=0) / n,
        m.n_words / max(1, m.raw.count(b".")),
        1 - len(m.text) / size if m.raw else 0.0,
    ]


def featured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with an array ``features``."""
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], x], names=[*rest, "features"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return docs.select(text_col, *rest).mapInArrow(run, kinds + "features array<double>")


@dataclass
class Model:
    """Edges of each feature's bins, a table per feature, and tables of pairs over coarser bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], "right")]
        for (f, g), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _leaves(g: np.ndarray, h: np.ndarray, l2: float, depth: int) -> tuple[np.ndarray, float]:
    """A tree of at most ``depth`` splits in a row over ordered bins: value per bin, and the gain."""
    value = lambda a, b: a / (b + l2)
    gain = lambda a, b: a * a / (b + l2)
    out, whole = np.full(len(g), value(g.sum(), h.sum())), gain(g.sum(), h.sum())
    if depth == 0 or len(g) < 2:
        return out, whole
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    each = gain(cg, ch) + gain(g.sum() - cg, h.sum() - ch)
    at = int(np.argmax(each)) + 1
    if each[at - 1] <= whole + 1e-9:
        return out, whole
    a, ga = _leaves(g[:at], h[:at], l2, depth - 1)
    b, gb = _leaves(g[at:], h[at:], l2, depth - 1)
    return np.concatenate([a, b]), ga + gb


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """The best pair of cuts of a two-way table: value per cell, and the gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c: np.ndarray) -> np.ndarray:
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return np.stack([a, b, d, c[-1, -1] - a - b - d])

    pg, ph = parts(cg), parts(ch)
    each = (pg * pg / (ph + l2)).sum(0)
    if not each.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(np.argmax(each)), each.shape)
    v = pg[:, i, j] / (ph[:, i, j] + l2)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(each[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 32, coarse_bins: int = 8, n_pairs: int = 6, depth: int = 2, l2: float = 2.0) -> Model:
    """Cyclic boosting on the log loss, main effects first. Labels of one kind, or none, give a constant model."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nf = x.shape[1]
    edges = [_edges(x[:, f], bins) if len(x) else np.empty(0) for f in range(nf)]
    coarse = [_edges(x[:, f], coarse_bins) if len(x) else np.empty(0) for f in range(nf)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(base, edges, tables, coarse, {})
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(edges[f], x[:, f], "right") for f in range(nf)]
    wide = [np.searchsorted(coarse[f], x[:, f], "right") for f in range(nf)]
    logit = np.full(len(y), base)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-logit))), p * (1 - p))
    for _ in range(rounds):
        for f in range(nf):
            g, h = slopes()
            k = len(tables[f])
            step, _gain = _leaves(np.bincount(at[f], g, k), np.bincount(at[f], h, k), l2, depth)
            tables[f] += rate * step
            logit += rate * step[at[f]]

    def grid(f: int, g_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
        shape = (len(coarse[f]) + 1, len(coarse[g_]) + 1)
        return wide[f] * shape[1] + wide[g_], *slopes(), shape

    def summed(f: int, g_: int) -> tuple[np.ndarray, tuple[np.ndarray, float]]:
        cell, g, h, shape = grid(f, g_)
        k = shape[0] * shape[1]
        return cell, _quadrants(np.bincount(cell, g, k).reshape(shape), np.bincount(cell, h, k).reshape(shape), l2)

    best = sorted(combinations(range(nf), 2), key=lambda p: -summed(*p)[1][1])[:n_pairs]
    model.pairs = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in best}
    for _ in range(rounds // 2):
        for p in best:
            cell, (step, _gain) = summed(*p)
            model.pairs[p] += rate * step
            logit += rate * step.ravel()[cell]
    return model


def held_out(id_col: str):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3, F.lit(0)) == 1


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from at most ``sample_rows`` labelled rows, none of them held out.

    The sample is drawn by the ids' hash before documents are joined; it alone reaches the driver, as
    features. Null ids and labels are left out; an id with several labels has their rounded mean.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.when(F.avg(label_col) >= 0.5, 1.0).otherwise(0.0).alias("y"))
    n = known.count()
    space = 1 << 20
    drawn = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(space)) < F.lit(int(min(1.0, 0.97 * sample_rows / max(1, n)) * space))
    some = docs.where(drawn(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = featured(some.join(known.where(drawn(F.col("id"))), "id").select("id", "text", "y")).limit(sample_rows).toPandas()
    rows = rows.sort_values("id", kind="stable")  # one order on every run: sums are then the same
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), len(NAMES))
    return fit(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted.

    Null texts score as empty ones, null ids aren't held out, repeated rows score alike; an empty table gives
    an empty result and other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(2).to_pylist()], float).reshape(b.num_rows, len(NAMES))
            p = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
