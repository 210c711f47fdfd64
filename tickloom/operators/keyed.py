"""Latest-value tables and duplicate removal."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame, key: tuple[str, ...], order: tuple[str, ...], *, live: Column | None = None
) -> DataFrame:
    """Last record per key; records failing ``live`` (tombstones) never count.

    A partial aggregate: each map task ships one row per key.
    """
    if live is not None:
        df = df.filter(live)
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(newest.alias("_row")).select(*key, "_row.*")


def dedupe_ticks(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop redelivered ticks: same asset and sequence number."""
    if ticks.isStreaming:
        stamped = ticks.withColumn("event_time", F.timestamp_millis("pts"))
        return (
            stamped.withWatermark("event_time", delay)
            .dropDuplicatesWithinWatermark(["a", "seq"])
            .drop("event_time")
        )
    return ticks.dropDuplicates(["a", "seq"])
