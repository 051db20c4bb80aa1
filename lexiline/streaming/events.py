"""Windows and sessions over events, as batches or streams, and appends that happen once.

The plans are the same for both: a stream adds a watermark, and rows later than it are left out of windows that are closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if events.isStreaming and late else events


def tumbling(events: DataFrame, key: str, ts: str, width: str, late: str | None = "1 hour") -> DataFrame:
    """(key, start, end, n, last_ts) of windows of fixed width."""
    g = _watermarked(events, ts, late).groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))
    return g.select(key, "w.start", "w.end", "n", "last_ts")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str | None = "1 hour") -> DataFrame:
    """(key, first_ts, last_ts, n) of runs of events that follow each other within the gap."""
    g = _watermarked(events, ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))
    return g.select(key, "first_ts", "last_ts", "n")


def latest(events: DataFrame, key: str, ts: str, cadence: str, value: str, late: str | None = "1 hour") -> DataFrame:
    """(key, end, value): the last value of each key in each window of the cadence."""
    g = _watermarked(events, ts, late).groupBy(key, F.window(ts, cadence).alias("w")).agg(F.max_by(value, ts).alias(value))
    return g.select(key, "w.end", value)


def append_once(path: str):
    """A foreachBatch function: a batch that is run again after a failure replaces what its first run wrote, so each batch is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
