"""Streaming jobs: sources to sinks with checkpoints.

Frame parsing, filters, enrichment with the market dimension and record decoding
are the batch functions applied to a stream. What needs state is here.
"""
from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tickloom.functions.wire import envelope
from tickloom.operators.joins import as_alerts, enrich_alerts
from tickloom.operators.keyed import latest_per_key
from tickloom.operators.series import rank_movers
from tickloom.params import Params
from tickloom.schemas import ALERT, TICK
from tickloom.sources.topics import to_records, write_topic
from tickloom.streaming.processor import derive_stream, surges_of, ticks_of

#: Name of the folders of micro-batches.
BATCH = "batch_id"


def stamped(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis(ts)).withWatermark("event_time", delay)


def run_to_end(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Process everything the source has now, then stop (append sink)."""
    query = (
        df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def derived_sinks(
    events: DataFrame, markets: DataFrame, path: str, checkpoint: str, p: Params = Params(), *,
    initial: DataFrame | None = None, once: bool = False, order: tuple[str, ...] = (),
    topics: str | None = None,
) -> StreamingQuery:
    """One stateful pass writing ticks, alerts and snapshots.

    Each micro-batch writes to folders of its own number, so a batch that is run
    again after a failure replaces what it wrote before. With ``topics`` the same records
    are also written there as JSON record streams: ``ticks``, ``alerts``, ``snapshots`` below
    a folder or after ``kafka://host:port/prefix``. ``markets`` is read
    anew by every micro-batch; where it is a change log, ``order`` names its version
    columns and alerts take the newest version.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        alerts = as_alerts(enrich_alerts(surges_of(batch), markets, order=order), p.surge_window_s)
        outputs = {"ticks": ticks_of(batch), "alerts": alerts, "snapshots": ticks_of(batch, "snapshot")}
        for name, rows in outputs.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
            if topics is not None:
                layout = ALERT if name == "alerts" else TICK
                fields = [f.split()[0].strip("`") for f in layout.split(", ")]
                records = rows.select(*fields)
                if topics.startswith("kafka://"):
                    write_topic(records, f"{topics}{name}", "a")
                else:
                    to_records(records, "a").select("value").write.mode("overwrite").text(
                        f"{topics}/{name}/batch={batch_id}")
        batch.unpersist()

    writer = derive_stream(events, p, initial).writeStream.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(write).start()


def appended(
    stream: DataFrame, path: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame] | None = None, *,
    once: bool = False, mode: str = "append",
) -> StreamingQuery:
    """Append what ``keep`` leaves of each micro-batch, below the micro-batch's number.

    A micro-batch that is run again after a failure replaces what it wrote before. The folder
    holds the stream's schema from the start, so a stream without rows is an empty table.
    ``mode="update"`` takes an aggregate's changed rows.
    """
    empty = stream.sparkSession.createDataFrame([], stream.schema)
    empty.write.mode("overwrite").parquet(f"{path}/{BATCH}=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*stream.columns)
        (keep(rows) if keep else rows).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(write).start()


def latest_table(
    stream: DataFrame, path: str, checkpoint: str, key: tuple[str, ...], order: tuple[str, ...], **options: Any,
) -> StreamingQuery:
    """Append the newest row per key of each micro-batch; :func:`read_latest` merges them."""
    return appended(stream, path, checkpoint, lambda rows: latest_per_key(rows, key, order), **options)


def read_latest(spark: SparkSession, path: str, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Newest row per key of a table kept by :func:`latest_table`; of equals the last written."""
    return latest_per_key(spark.read.parquet(path), key, (*order, BATCH)).drop(BATCH)


def top_table(movers: DataFrame, path: str, checkpoint: str, n: int, **options: Any) -> StreamingQuery:
    """Append the ``n`` largest changes of every instant (``ts, a, c5m``) in each micro-batch.

    The list of an instant grows while changes of it come in; it is complete when the
    watermark has passed the instant. Read with :func:`read_top`.
    """
    best = lambda rows: rank_movers(rows.distinct(), n, by=("ts",)).drop("rank")
    return appended(movers, path, checkpoint, best, **options)


def read_top(spark: SparkSession, path: str, n: int) -> DataFrame:
    """``ts, a, c5m, rank``: the lists of :func:`top_table`; no rows while there are no movers."""
    return rank_movers(spark.read.parquet(path).drop(BATCH).distinct(), n, by=("ts",))


def rates(stream: DataFrame, ts: str, window: str, delay: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Records per tumbling event-time window.

    An append sink gets a window when it closes; to have the open ones as well, keep the
    result with ``latest_table(..., order=("n",), mode="update")``.
    """
    grouped = stamped(stream, ts, delay).groupBy(F.window("event_time", window), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(
        (F.unix_millis("window.start")).alias("start"), *by, "n"
    )


def counts(stream: DataFrame, kind: str = "kind") -> DataFrame:
    """Running totals per kind (update or complete output mode)."""
    return stream.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def conflated(deliveries: DataFrame, flush: str, delay: str, *, value: str = "value") -> DataFrame:
    """Newest delivery per client, key and flush window, with its ``ts`` and ``ord``.

    An append sink gets a window when it closes; to have the open ones as well, keep the
    result with ``latest_table(..., order=("ts", "ord"), mode="update")``.
    """
    newest = F.max_by(F.struct("ts", "ord", value), F.struct("ts", "ord")).alias("_m")
    return (
        stamped(deliveries, "ts", delay).groupBy(F.window("event_time", flush), "client_id", "ch", "id")
        .agg(newest)
        .select(
            F.unix_millis("window.start").alias("flush"), "client_id", "ch", "id", "_m.ts", "_m.ord", f"_m.{value}"
        )
    )


def tick_messages(conflated_rows: DataFrame, value: str = "value") -> DataFrame:
    """A closed window's ticks as one message per client (batch or foreachBatch)."""
    return (
        conflated_rows.filter(F.col("ch") == "asset").groupBy("client_id", "flush")
        .agg(F.array_sort(F.collect_list(F.struct("id", value))).alias("_i"))
        .select("client_id", "flush", envelope("ticks", F.transform("_i", lambda i: i[value])).alias("frame"))
    )
