"""Fixed-window limiter whose window starts at a key's first hit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limit_hits(events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_s: float) -> DataFrame:
    """(event_id, key, allowed). Rows of a key come sorted to one task, which keeps one key's window
    at a time, so a key of any size streams through."""

    def run(frames):
        now, opened, hits = object(), 0.0, 0
        for pdf in frames:
            allowed = []
            for k, t in zip(pdf["key"], pdf["t"], strict=True):
                if k != now or t >= opened + window_s:
                    now, opened, hits = k, t, 0
                hits += 1
                allowed.append(hits <= limit)
            yield pd.DataFrame({"event_id": pdf["event_id"], "key": pdf["key"], "allowed": allowed})

    rows = events.select(F.col(event_id).alias("event_id"), F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).withColumn("t", F.col("us") / 1e6)
    kind = rows.schema
    return rows.repartition("key").sortWithinPartitions("key", "us", "event_id").mapInPandas(run, f"event_id {kind['event_id'].dataType.simpleString()}, key {kind['key'].dataType.simpleString()}, allowed boolean")
