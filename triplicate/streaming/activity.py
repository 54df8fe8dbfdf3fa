"""Counters and limits over a stream of events. The batch forms give the same rows over a whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each type in each tumbling window; as a stream, those later than ``late`` are left out."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def recent_hits(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """For each event how many of its user fall in the ``seconds`` up to it, itself among them."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("hits", F.count("*").over(w))


def allowed(times: list[float], limit: int, seconds: float, kept: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Whether each hit passes a sliding limit: refused hits do not count towards it. Also the hits still in the window."""
    kept, out = list(kept or []), []
    for t in times:
        kept = [k for k in kept if k > t - seconds]
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out, kept


def fixed_window(times: list[float], limit: int, seconds: float, kept: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Whether each hit passes a limit in windows that begin with a user's first hit after the last one; the window so far."""
    kept, out = list(kept or []), []
    for t in times:
        if not kept or t >= kept[0] + seconds:
            kept = [t]
        else:
            kept.append(t)
        out.append(len(kept) <= limit)
        kept = kept[: limit + 1]
    return out, kept


def limited(events: DataFrame, limit: int = 3, seconds: float = 3600.0, rule: Callable = allowed) -> DataFrame:
    """event_id, user_id and whether each event passes its user's limit, over a table.

    Events stream through by user and time; what is held of a user is the hits that ``rule`` keeps, a few numbers.
    """
    schema = pa.schema([("event_id", pa.int64()), ("user_id", pa.int64()), ("passes", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, kept = None, []
        for batch in batches:
            passes: list[bool] = []
            for u, t in zip(batch.column("user_id").to_pylist(), batch.column("micros").to_pylist(), strict=True):
                if u != user:
                    user, kept = u, []
                passed, kept = rule([t / 1e6], limit, seconds, kept)
                passes += passed
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("user_id"), pa.array(passes, pa.bool_())], schema=schema)

    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "micros", "event_id").mapInArrow(run, "event_id long, user_id long, passes boolean")


def limited_stream(events: DataFrame, limit: int = 3, seconds: float = 3600.0, rule: Callable = allowed, late: str = "10 minutes") -> DataFrame:
    """The same for a stream, hits in the order in which micro-batches bring them.

    What is held of a user goes once the watermark, ``late`` behind the latest hit, has passed the last kept hit by a
    window: by then it can't matter any more. Hits behind the watermark are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept: list[Any] = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(["ts", "event_id"])  # one user's hits of one micro-batch
        passes, kept = rule([t.timestamp() for t in rows["ts"]], limit, seconds, kept)
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((max(kept, default=0.0) + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield rows[["event_id", "user_id"]].assign(passes=passes)

    timed = events.withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, passes boolean", "kept array<double>", "append", "EventTimeTimeout")


def beats(events: DataFrame, silence: str = "2 days", late: str = "1 hour") -> DataFrame:
    """Stretches in which a user's job told something at least every ``silence``: started, last_seen and how often.

    As a stream a stretch is told once the watermark has passed the time by which the job should have told something: a
    silent job is found by the time that passes elsewhere, without an event of its own. What is held is one row a user.
    """
    source = events.withWatermark("ts", late) if events.isStreaming else events
    stretch = source.groupBy("user_id", F.session_window("ts", silence).alias("w"))
    return stretch.agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("n")).select("user_id", "started", "last_seen", "n")
