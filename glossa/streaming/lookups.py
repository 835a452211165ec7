"""Search as you type: a stream of query events against a static index, and statistics over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_keystrokes(events: DataFrame, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """user_id, window, word: the last word typed by each user in each window; late events count up to the delay.

    Each keystroke replaces what the same user typed before. events: ts, user_id, word.
    """
    grouped = events.withWatermark("ts", delay).groupBy("user_id", F.window("ts", window).alias("window"))
    return grouped.agg(F.max_by("word", "ts").alias("word"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """user_id, start, end, keystrokes, word: runs of keystrokes that no pause of ``gap`` parts, with the word that stands in the end.

    A late keystroke within the delay may join two runs. events: ts, user_id, event_id, word.
    """
    run = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    out = run.agg(F.count(F.lit(1)).alias("keystrokes"), F.max_by("word", F.struct("ts", "event_id")).alias("word"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "keystrokes", "word")


STATE = "ts timestamp, event_id long, word string, keystrokes long"


def standing_words(events: DataFrame, delay: str = "10 minutes", idle: str = "30 minutes") -> DataFrame:
    """user_id, word, ts, keystrokes, open: what stands in each user's search box, an update for each user and batch.

    A keystroke replaces the word, unless it is older than the one that stands: then it only counts. A box without a keystroke for ``idle``,
    by the watermark, is closed and forgotten. events: ts, user_id, event_id, word. A user's state is one row.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(user: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, None, 0)
        row = lambda s, is_open: pd.DataFrame({"user_id": [user[0]], "word": [s[2]], "ts": [s[0]], "keystrokes": [s[3]], "open": [is_open]})
        if state.hasTimedOut:
            state.remove()
            yield row(held, False)
            return
        for b in batches:
            last = b.sort_values(["ts", "event_id"]).iloc[-1]
            newer = held[0] is None or (last["ts"], last["event_id"]) > (pd.Timestamp(held[0]), held[1])
            top = (last["ts"].to_pydatetime(), int(last["event_id"]), last["word"]) if newer else held[:3]
            held = (*top, held[3] + len(b))
        state.update(held)
        state.setTimeoutTimestamp(max(int(pd.Timestamp(held[0]).timestamp() * 1000) + wait, state.getCurrentWatermarkMs() + 1))
        yield row(held, True)

    keyed = events.withWatermark("ts", delay).select("user_id", "ts", "event_id", "word").groupBy("user_id")
    return keyed.applyInPandasWithState(update, "user_id long, word string, ts timestamp, keystrokes long, open boolean", STATE, "update", GroupStateTimeout.EventTimeTimeout)


def answered(events: DataFrame, entries: DataFrame, longest: int = 8) -> DataFrame:
    """Query events joined to the entries whose first letters they are; entries: beginnings() up to the same length.

    A longer word meets the keys that have its first ``longest`` letters, and is compared with them in full.
    """
    first = F.substring(events["word"], 1, longest)
    return events.join(entries, (first == entries["begin"]) & F.startswith(entries["key"], events["word"]))


def busy_words(events: DataFrame, delay: str = "10 minutes", window: str = "10 minutes") -> DataFrame:
    """word, start, n: how often each word was asked for in each window."""
    counts = events.withWatermark("ts", delay).groupBy("word", F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("word", F.col("w.start").alias("start"), "n")


def beginnings(entries: DataFrame, longest: int = 8) -> DataFrame:
    """entries with ``begin``: one row for each beginning of the key up to a length, for joins with a stream."""
    lengths = F.sequence(F.lit(1), F.least(F.length("key"), F.lit(longest)))
    return entries.withColumn("begin", F.explode(F.transform(lengths, lambda n: F.substring(F.col("key"), F.lit(1), n))))
