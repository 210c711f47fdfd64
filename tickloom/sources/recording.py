"""Recordings: ``{"t":kind,"d":payload}`` lines in gzip text files by date and hour."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.numbers import hour_of
from tickloom.schemas import MANIFEST
from tickloom.session import once


def recording_lines(stream: DataFrame, t: str = "t", d: str = "d") -> DataFrame:
    """``t, d`` rows as lines with the event's own time and its UTC date and hour."""
    own = F.when(F.col(t) == "tick", F.get_json_object(d, "$.pts")).otherwise(F.get_json_object(d, "$.ts"))
    ts = own.cast("bigint")
    line = F.concat(F.lit('{"t":"'), F.col(t), F.lit('","d":'), F.col(d), F.lit("}"))
    rows = stream.select(ts.alias("ts"), line.alias("value"))
    date, hour = hour_of("ts")
    return rows.select("ts", "value", date.alias("date"), hour.alias("hour"))


def write_recording(stream: DataFrame, path: str, *, checkpoint: str | None = None, once: bool = False):
    """Append lines to ``date=.../hour=...`` folders; a restart only adds files.

    In batch the rows are rebalanced by hour: small hours share a task, a busy hour
    is split over several tasks and files.
    """
    lines = recording_lines(stream).select("value", "date", "hour")
    if stream.isStreaming:
        writer = (
            lines.writeStream.format("text").partitionBy("date", "hour")
            .option("compression", "gzip").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
        )
        if once:
            writer = writer.trigger(availableNow=True)
        return writer.start()
    lines = lines.hint("rebalance", "date", "hour")
    lines.write.partitionBy("date", "hour").option("compression", "gzip").mode("append").text(path)
    return None


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Recording lines to ``ts, kind, data``; blank and undecodable lines are skipped."""
    rest = [c for c in lines.columns if c != value]
    filled = lines.filter(F.length(F.trim(value)) > 0).select(*rest, F.col(value).alias("line"))
    rec = once(filled, "_r", F.from_json("line", "t string, d string"))
    own = F.when(F.col("_r.t") == "tick", F.get_json_object("_r.d", "$.pts")).otherwise(
        F.get_json_object("_r.d", "$.ts")
    )
    return rec.filter(F.col("_r.t").isNotNull()).select(
        *rest, "line", own.cast("bigint").alias("ts"), F.col("_r.t").alias("kind"), F.col("_r.d").alias("data")
    )


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    """``ts, kind, data, line, file, pos`` of a recording (``date``/``hour`` prune files)."""
    lines = spark.read.text(path).select(
        "*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos")
    )
    return parse_lines(lines)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One row, one file."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)
