"""The state of each agent of a project from its stream of progress events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The status that an event leaves; a status that ends a run stays.
STATUS_OF_EVENT = {"view": "pending", "click": "running", "signup": "running", "purchase": "completed", "error": "error"}
FINAL = ["completed", "error"]


def with_status(events: DataFrame, event: str = "event_type") -> DataFrame:
    names = F.create_map(*[F.lit(x) for p in STATUS_OF_EVENT.items() for x in p])
    return events.withColumn("status", F.coalesce(F.try_element_at(names, F.col(event)), F.lit("pending")))


def final_state(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Batch form: per key the first ending status, else the last status, and the number of all its events."""
    s = with_status(events)
    ended = F.min(F.when(F.col("status").isin(FINAL), F.col(seq)))
    per = s.groupBy(key).agg(ended.alias("_end"), F.min_by("status", F.when(F.col("status").isin(FINAL), F.col(seq))).alias("_ending"), F.max_by("status", seq).alias("_last"), F.count("*").alias("events"))
    return per.select(key, F.coalesce("_ending", "_last").alias("status"), "events", F.col("_end").isNotNull().alias("ended"))


def stream_state(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Streaming form of :func:`final_state`: each key's state lives in the state store."""
    out = f"{key} long, status string, events long, ended boolean"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, count, last, end = state.get if state.exists else ("pending", 0, -1, -1)
        for pdf in batches:
            count += len(pdf)
            for at, s in zip(pdf[seq], pdf["status"]):
                if s in FINAL:
                    if end < 0 or at < end:
                        status, end = s, int(at)
                elif end < 0 and at > last:
                    status = s
                last = max(last, int(at))
        state.update((status, count, last, end))
        yield pd.DataFrame({key: [k[0]], "status": [status], "events": [count], "ended": [end >= 0]})

    return with_status(events).groupBy(key).applyInPandasWithState(update, out, "status string, events long, last long, ended long", "update", "NoTimeout")


def windowed_counts(events: DataFrame, ts: str = "ts", event: str = "event_type", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per kind and window; on a stream, rows later than the watermark are left out."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, width).alias("w"), event).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), event, "n")
