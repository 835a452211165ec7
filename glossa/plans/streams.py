"""Queries over streams: each reads the table as a stream to its end, and the result is what the sink then holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.stored import fresh_path
from ..streaming import lookups as S
from .corpora import HEADWORDS, headwords
from .registry import query


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream. A table may be one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path + "*")


def drained(spark: SparkSession, out: DataFrame) -> DataFrame:
    """Runs a stream of whole results over all that is there; each batch replaces the table of the one before it."""
    path = fresh_path(spark, "stream")

    def replace(batch: DataFrame, _number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result")

    writer = out.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/result")


def updates(spark: SparkSession, out: DataFrame) -> DataFrame:
    """Runs a stream of updates over all that is there; each batch is kept beside the others, with its number."""
    path = fresh_path(spark, "updates")

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure replaces itself.
        batch.write.mode("overwrite").parquet(f"{path}/result/batch={number}")

    writer = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*out.schema.fields]).add("batch", "long")).parquet(f"{path}/result")


def typed(events: DataFrame) -> DataFrame:
    """Events as keystrokes: the type's first letters are the word."""
    n = (F.col("user_id") % 3 + 1).cast("int")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_id", F.upper(F.substring("event_type", F.lit(1), n)).alias("word"))


TYPED = "(SELECT ts, user_id, event_id, upper(left(event_type, (user_id % 3 + 1)::INT)) AS word FROM events)"


@query(f"SELECT word, strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM {TYPED} GROUP BY ALL")
def stream_busy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.busy_words(typed(stream_of(spark, sf_dir, "events")), delay="100 days")
    return drained(spark, out).select("word", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(f"SELECT t.word, count(*) AS hits FROM {TYPED} t JOIN (SELECT DISTINCT key FROM {HEADWORDS}) h ON starts_with(key, t.word) GROUP BY ALL")
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of words joined to the static index; hits are counted by word."""
    keys = S.beginnings(headwords(spark, sf_dir).select("key").distinct())
    out = S.answered(typed(stream_of(spark, sf_dir, "events")).select("word"), keys)
    return drained(spark, out.groupBy("word").agg(F.count(F.lit(1)).alias("hits")))


@query(
    f"""WITH t AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM {TYPED}),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM t)
        SELECT user_id, count(*) AS keystrokes, arg_max(word, (ts, event_id)) AS word, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end" FROM s GROUP BY user_id, nth"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's runs of keystrokes, parted by pauses of half an hour."""
    out = drained(spark, S.sessions(typed(stream_of(spark, sf_dir, "events")), delay="100 days"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", "keystrokes", "word", shown("start"), shown("end"))


@query(f"SELECT user_id, arg_max(word, (ts, event_id)) AS word, count(*) AS keystrokes FROM {TYPED} GROUP BY user_id")
def stream_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in each user's search box after all keystrokes: the last update of each."""
    out = updates(spark, S.standing_words(typed(stream_of(spark, sf_dir, "events")), delay="100 days", idle="100 days"))
    return out.where("open").groupBy("user_id").agg(F.max_by("word", "keystrokes").alias("word"), F.max("keystrokes").alias("keystrokes"))


@query(f"SELECT user_id, strftime(time_bucket(INTERVAL 1 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, arg_max(word, ts) AS word FROM {TYPED} GROUP BY ALL")
def stream_last_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word that each user typed in each minute."""
    out = drained(spark, S.latest_keystrokes(typed(stream_of(spark, sf_dir, "events")), delay="100 days"))
    return out.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "word")
