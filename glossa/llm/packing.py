"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of documents in seeded order. In every window a queue's deficit grows by its share of
the window's tokens and it sends the documents that the deficit covers; what is left is carried on. When a
queue has run out, its share passes to the queues that are left, by their weights. Quanta that add up to v
times a queue's weight are reached at the same v in every queue that still lasts, and the stream then holds
the least of each queue's tokens and v times its weight, added up: a piecewise linear function with a bend where
a queue runs out. A document's window thus follows from its queue's running total alone, and running totals are
taken in two levels: within bounded chunks, and over the chunks. The windows, one after the other, make one
stream of tokens, which is cut into sequences; deficits carry over windows, tasks and machines alike.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from collections.abc import Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What libraries may split differently: white space but single spaces and line ends, control characters, and
#: characters beyond the letters and signs of common scripts.
ODD = re.compile(r"[^\n -~\u00a1-\u024f\u0370-\u03ff\u0400-\u052f\u2010-\u2027\u3041-\u30ff\u4e00-\u9fa5]|  | \n|\n |\n\n")
#: Fixed value: the pattern that splits text before the merges of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Coder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers, equal to the tokenizer's own.

    With ``ranks``, the file of the same vocabulary as ranks, plain texts are encoded by the ranks straight into
    bytes, without a Python object for each id. Texts in which libraries may differ, and those with a special
    token's string, go to the tokenizer.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks and sys.byteorder == "little":
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or ODD.search(text) or any(x in text for x in self.special):
            return little_endian(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        return self.fast.encode_to_numpy(text, disallowed_special=()).tobytes()


@cache
def coder_for(path: str, ranks: str | None) -> Coder:
    """One tokenizer for each file and Python worker. Tasks find it by its name in this module."""
    return Coder(path, ranks)


def tokenized(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, eos: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, source, doc_tokens and ids (binary, little-endian unsigned 32 bits) with the end id."""
    end = np.asarray([eos], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder_for(tokenizer, ranks).encode
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [encode(t or "") + end for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "doc_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, source string, doc_tokens long, ids binary")


def bends(tokens: Mapping[str, int], weights: Mapping[str, float]) -> list[tuple[float, float, float]]:
    """v, tokens, slope: from each v on the stream holds tokens + slope * (v - that v), until the next one."""
    ends = sorted((tokens[q] / weights[q], q) for q in tokens)
    slope = sum(weights[q] for q in tokens)
    out, at, held = [], 0.0, 0.0
    for v, q in ends:
        out.append((at, held, slope))
        held, at = held + slope * (v - at), v
        slope -= weights[q]
    return out


def stream_place(v: Column, tokens: Mapping[str, int], weights: Mapping[str, float]) -> Column:
    """How many tokens the stream holds when quanta have reached v times each weight."""
    out = None
    for at, held, slope in bends(tokens, weights):
        piece = F.lit(held) + F.lit(slope) * (v - F.lit(at))
        out = piece if out is None else F.when(v > at, piece).otherwise(out)
    return out if out is not None else v


def stream_starts(meta: DataFrame, weights: Mapping[str, float] | None, window_tokens: int, seed: int = 7, chunk_rows: int = 2_000, group: int = 1024) -> DataFrame:
    """rk, begin: where each document begins in the packed stream. meta: rk, doc_id, source, n.

    With weights the queues are the sources that they name and one for all others, so that no more totals than
    that reach the driver; without, each source is a queue and its weight is what it holds.
    """
    if weights:
        named = F.col("source").isin(*weights)
        meta = meta.withColumn("source", F.when(named, F.col("source")))
    stats = written(meta.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")), "queues")
    if weights:
        totals = {r["source"]: r["tokens"] for r in stats.collect()}
        least = min(weights.values())
        share = {q: float(weights.get(q, least)) for q in totals}
        weight = F.lit(float(least))
        for q, w in share.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(q)), F.lit(w)).otherwise(weight)
        place = stream_place(F.col("upto") / weight, totals, share)
    else:
        total = stats.agg(F.sum("tokens")).first()[0] or 1
        place = F.col("upto") / F.greatest("tokens", F.lit(1)) * float(total)

    queues = stats.select(F.col("source").alias("queue"), "tokens", F.ceil(F.col("rows") / chunk_rows).cast("long").alias("chunks"))
    h = F.xxhash64("doc_id", F.lit(seed))
    rows = meta.join(queues, F.col("source").eqNullSafe(F.col("queue"))).drop("queue")
    rows = rows.withColumn("h", h).withColumn("chunk", F.expr("(shiftrightunsigned(h, 33) * chunks) DIV 2147483648"))
    # Repeated and null ids share a hash: a chunk that they crowd is dealt out again by row.
    crowded = rows.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 4 * chunk_rows)
    crowded = written(crowded.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.ceil(F.col("rows") / chunk_rows).alias("parts")), "crowded")
    rows = rows.join(crowded, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")), "left")
    rows = rows.withColumn("part", F.coalesce(F.pmod(F.xxhash64("rk"), F.col("parts")), F.lit(0))).drop("s", "c", "parts")
    sums = rows.groupBy("source", "chunk", "part").agg(F.sum("n").alias("t"))
    before = F.sum("t").over(Window.partitionBy("source").orderBy("chunk", "part")) - F.col("t")
    chunks = written(sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.col("part").alias("p"), before.alias("before")), "chunks")
    # Unsigned order of the hash, as chunks have it.
    order = Window.partitionBy("source", "chunk", "part").orderBy(F.expr("shiftrightunsigned(h, 1)"), "h", "doc_id", "rk")
    upto = F.col("before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    sent = rows.join(chunks, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")) & (F.col("part") == F.col("p"))).withColumn("upto", upto)
    # The quanta of window w add up to w windows; what they cover is sent. A little less, for the rounding of shares.
    sent = sent.select("rk", "source", "n", "upto", F.ceil(place / window_tokens - 1e-9).cast("long").alias("window"))
    sent = written(sent, "windows")

    sizes = sent.groupBy("window").agg(F.sum("n").alias("t")).withColumn("block", F.expr(f"window DIV {group}"))
    blocks = sizes.groupBy("block").agg(F.sum("t").alias("bt"))
    blocks = blocks.select("block", (F.sum("bt").over(Window.partitionBy().orderBy("block")) - F.col("bt")).alias("base"))
    inside = F.sum("t").over(Window.partitionBy("block").orderBy("window")) - F.col("t")
    windows = sizes.join(blocks, "block").select("window", (F.col("base") + inside).alias("at"))
    within = Window.partitionBy("window").orderBy("source", "upto", "rk").rowsBetween(Window.unboundedPreceding, 0)
    return sent.join(windows, "window").select("rk", (F.col("at") + F.sum("n").over(within) - F.col("n")).alias("begin"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    length: int = 2048,
    eos: int = 1,
    weights: Mapping[str, float] | None = None,
    window_sequences: int = 64,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary).

    All documents are packed; a null text is empty and has the end id alone. tokenizer and ranks: see Coder.
    weights: target proportions of the sources in every window; sources that it doesn't name are one queue of the
    least weight. A queue that runs out leaves its share to the others. Without weights the sources' own
    proportions, so that all queues end together. Sequences are full but for the last one. Null sources are
    one queue named "". Rows that repeat an id are documents of their own; null ids too. An empty table gives an
    empty result, and other columns aren't read.
    """
    tokens = tokenized(docs, tokenizer, ranks, eos, id_col, text_col, source_col)
    store = written(tokens.withColumn("rk", F.monotonically_increasing_id()), "tokens")
    starts = stream_starts(store.select("rk", "doc_id", "source", F.col("doc_tokens").alias("n")), weights, window_sequences * length, seed)
    # A sort-merge join at every size: the starts grow with the documents and must not be broadcast.
    placed = store.select("rk", "doc_id", "doc_tokens", "ids").join(starts.hint("merge"), "rk")
    pieces = placed.withColumn("sequence_id", F.explode(F.expr(f"sequence(begin DIV {length}, (begin + doc_tokens - 1) DIV {length})")))
    at = F.col("sequence_id") * length
    start = F.greatest(at - F.col("begin"), F.lit(0).cast("long"))
    n = F.least(at + length - F.col("begin"), F.col("doc_tokens")) - start
    return pieces.select(
        F.col("doc_id").alias(id_col),
        start.alias("start"),
        n.alias("length"),
        "doc_tokens",
        "sequence_id",
        F.greatest(F.col("begin") - at, F.lit(0).cast("long")).alias("offset"),
        F.substring("ids", (start * 4 + 1).cast("int"), (n * 4).cast("int")).alias("ids"),
    )
