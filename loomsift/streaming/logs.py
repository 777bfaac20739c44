"""Continuous logs: windowed signatures, sessions, first sightings, duplicates, and distillation by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomsift.operators.routing import Registry, distil

LATE = "10 minutes"


def hourly(records: DataFrame, keys: list[str], ts: str = "ts", every: str = "1 hour", late: str = LATE) -> DataFrame:
    """Counts and first event by window and keys; late rows are taken for ``late``. A batch frame gives the same rows at once."""
    stamped = records.withColumn(ts, F.col(ts).cast("timestamp"))
    if records.isStreaming:
        stamped = stamped.withWatermark(ts, late)
    grouped = stamped.groupBy(F.window(ts, every).alias("w"), *keys).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "first_ts")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Bursts of a user's events without a longer pause than ``gap``."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(ts, late)
    grouped = stamped.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(records: DataFrame, keys: list[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """Records without exact repeats within the watermark."""
    stamped = records.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if records.isStreaming else stamped.dropDuplicates(keys)


def first_seen(records: DataFrame, key: str = "sig", ts: str = "ts", forget_ms: int = 7 * 24 * 3600 * 1000, late: str = LATE) -> DataFrame:
    """(key, ts): the first record of each signature in a stream, told again only after ``forget_ms`` of event time without one.

    Signatures are forgotten as the watermark passes, so a stream that reads what is there
    and stops does end. Rows later than ``late`` may be left out; rows without a time tell
    of their signature but do not keep it in mind.
    """
    at = f"{key}_{ts}_ms"

    def told(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches))
        last = max([*pdf[at].dropna(), *(state.get if state.exists else ()), state.getCurrentWatermarkMs()])
        if not state.exists:
            yield pd.DataFrame({key: [keys[0]], ts: [pdf[ts].min()]})
        state.update((int(last),))
        state.setTimeoutTimestamp(int(last) + forget_ms)

    stamped = records.select(key, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late).withColumn(at, F.unix_millis(ts))
    return stamped.groupBy(key).applyInPandasWithState(told, f"{key} string, {ts} timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def distil_stream(outputs: DataFrame, path: str, checkpoint: str, registry: Registry | None = None) -> StreamingQuery:
    """Documents of a stream distilled batch by batch into a table at ``path``."""

    def one(batch: DataFrame, number: int) -> None:
        distil(batch, registry).withColumn("batch", F.lit(number)).write.mode("append").partitionBy("batch").parquet(path)

    return outputs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
