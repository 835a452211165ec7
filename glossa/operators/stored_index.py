"""An index that is written once, sorted by key in ranges, and asked by batches of words without moving its entries.

Entries are range-partitioned by key and kept as one bucket a range. A batch of words becomes ranges of keys, [word, what no longer
begins with it), which the same splitters deal to the buckets; each bucket meets its words in one task, where two binary searches
find a word's run of entries. Only words are shuffled, a row for each bucket that a word's run touches.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import fresh_path


def run_of(keys: Sequence[str], word: str, exact: bool = False) -> tuple[int, int]:
    """The first of the sorted keys that begins with (or is) the word, and the first after the last one."""
    return bisect_left(keys, word), bisect_right(keys, word, key=None if exact else lambda k: k[: len(word)])


def _goes_on(firsts: Sequence[str], bucket: int, word: str) -> bool:
    """Whether the next bucket begins within the word's run."""
    return bucket + 1 < len(firsts) and firsts[bucket + 1][: len(word)] <= word


@dataclass(frozen=True)
class StoredIndex:
    """Where an index is, its key, and the first key of each bucket, as many as there are buckets."""

    spark: SparkSession
    table: str
    key: str
    firsts: tuple[str, ...]

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def buckets_of(self, words: DataFrame, exact: bool) -> DataFrame:
        """word, bucket: a row for each bucket that may have entries of a word. Equal keys may stand in several buckets."""
        firsts = self.firsts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words, buckets = [], []
                for word in b.column(0).to_pylist():
                    low, high = run_of(firsts, word, exact)
                    for i in range(max(0, low - 1), max(high, 1)):
                        words.append(word)
                        buckets.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(buckets, pa.int32())], names=["word", "bucket"])

        return words.select("word").where("word IS NOT NULL").distinct().mapInArrow(run, "word string, bucket int")

    def matched(self, queries: DataFrame, exact: bool = False) -> DataFrame:
        """queries (with a column word) joined to the entries whose key begins with, or is, the word. An empty word meets all entries."""
        key, schema = self.key, self.entries().drop("bucket").schema
        dealt = self.buckets_of(queries, exact)

        def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
            held = held.drop_columns(["bucket"]).sort_by(key).combine_chunks()
            keys = held[key].to_pylist()
            at: list[int] = []
            words: list[str] = []
            for word in asked["word"].to_pylist():
                low, high = run_of(keys, word, exact)
                at.extend(range(low, high))
                words.extend([word] * (high - low))
            found = held.take(pa.array(at, pa.int64()))
            return pa.table([pa.array(words, pa.string()), *found.columns], names=["word", *held.column_names])

        # Buckets that no word touches stay out of Python; the entries keep their place in both steps.
        asked = self.entries().join(dealt.select("bucket").distinct(), "bucket", "left_semi")
        hits = dealt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(meet, "word string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
        return queries.join(hits, "word")

    def taken_while(self, queries: DataFrame, order: str = "ord") -> DataFrame:
        """matched(), but as a scan in ``order`` gives it that stops at the first entry whose key is beyond the word and doesn't begin with it.

        On an index whose order is that of its keys this is matched(). Else a word's stop is the least order number of all keys beyond its
        run: of its last bucket's the least of the bucket's end, taken in the bucket, of later buckets their least, one number each.
        """
        key = self.key
        least = self.entries().groupBy("bucket").agg(F.min(order).alias("first")).collect()  # one number for each bucket
        after, low = [None] * (len(self.firsts) + 1), None
        known = {r["bucket"]: r["first"] for r in least}
        for i in range(len(self.firsts) - 1, -1, -1):
            after[i] = low
            low = min((x for x in (low, known.get(i)) if x is not None), default=None)
        dealt, firsts = self.buckets_of(queries, False), self.firsts

        def stops(asked: pa.Table, held: pa.Table) -> pa.Table:
            held = held.sort_by(key)
            keys, numbers = held[key].to_pylist(), held[order].to_pylist()
            ends: list[int | None] = [None] * (len(keys) + 1)
            for i in range(len(keys) - 1, -1, -1):
                ends[i] = numbers[i] if ends[i + 1] is None else min(numbers[i], ends[i + 1])
            words, out = [], []
            for word, bucket in zip(asked["word"].to_pylist(), asked["bucket"].to_pylist()):
                high = run_of(keys, word)[1]
                words.append(word)
                # Where the run goes on in the next bucket, that one says what is beyond it.
                beyond = [] if _goes_on(firsts, bucket, word) else [x for x in (ends[high], after[bucket]) if x is not None]
                out.append(min(beyond, default=None))
            return pa.table([pa.array(words, pa.string()), pa.array(out, pa.int64())], names=["word", "stop"])

        asked = self.entries().select(key, order, "bucket").join(dealt.select("bucket").distinct(), "bucket", "left_semi")
        stop = dealt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(stops, "word string, stop long").groupBy("word").agg(F.min("stop").alias("stop"))
        hits = self.matched(queries).join(stop, "word", "left")
        return hits.where(F.col("stop").isNull() | (F.col(order) < F.col("stop"))).drop("stop")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def write_index(entries: DataFrame, key: str, order: Sequence[str] = ("ord",), bucket_rows: int = 100_000) -> StoredIndex:
    """entries as an index by key, in buckets of about ``bucket_rows``; of equal keys any may be split between buckets.

    The files are in the shared folder. Rows without a key are left out: no word begins a null.
    """
    spark = entries.sparkSession
    there = entries.where(F.col(key).isNotNull())
    n = max(1, -(-there.count() // bucket_rows))
    name = f"glossa_index_{uuid4().hex}"
    ranged = there.repartitionByRange(n, key, *order).withColumn("bucket", F.spark_partition_id())
    ranged.sortWithinPartitions("bucket", key).write.bucketBy(n, "bucket").sortBy("bucket").option("path", fresh_path(spark, "index")).saveAsTable(name)
    # The splitters: one key for each bucket, however many entries there are.
    firsts = spark.table(name).groupBy("bucket").agg(F.min(key).alias("first")).orderBy("bucket").collect()
    known = {r["bucket"]: r["first"] for r in firsts}
    filled, last = [], ""
    for i in range(n):
        last = known.get(i, last)
        filled.append(last)
    return StoredIndex(spark, name, key, tuple(filled))
