"""Record streams: Kafka topics on a cluster, folders of JSON text elsewhere.

The Kafka branch is a thin pass-through to Spark's connector. The connector jar
is not part of this repository's test environment, so only the folder branch is
exercised by the tests.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import once


def _is_kafka(source: str) -> bool:
    return source.startswith("kafka://")


def _kafka_options(source: str) -> dict[str, str]:
    brokers, _, topic = source.removeprefix("kafka://").partition("/")
    return {"kafka.bootstrap.servers": brokers, "subscribe": topic}


def read_topic(
    spark: SparkSession, source: str, *, streaming: bool = False, start: str = "latest",
    max_per_trigger: int | None = None,
) -> DataFrame:
    """Records as ``key, value, partition, offset``.

    ``source`` is ``kafka://host:port/topic`` or a folder of JSON-lines files; in
    a folder the key is null and file order stands in for partition and offset (a
    stream of files has no offsets; events carry their own ``ord``).
    """
    if _is_kafka(source):
        reader = spark.readStream if streaming else spark.read
        options = _kafka_options(source) | {"startingOffsets": start}
        if streaming and max_per_trigger:
            options["maxOffsetsPerTrigger"] = str(max_per_trigger)
        if not streaming:
            options |= {"startingOffsets": "earliest", "endingOffsets": "latest"}
        return reader.format("kafka").options(**options).load().select(
            F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
            "partition", "offset",
        )
    if streaming:
        reader = spark.readStream
        if max_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_per_trigger)
        lines = reader.text(source)
    else:
        lines = spark.read.text(source)
    return lines.select(
        F.lit(None).cast("string").alias("key"), "value",
        F.lit(0).alias("partition"),
        (F.lit(None).cast("bigint") if streaming else F.monotonically_increasing_id()).alias("offset"),
    )


def read_topic_bounded(spark: SparkSession, source: str) -> DataFrame:
    """Everything in the topic up to its end at call time."""
    return read_topic(spark, source, streaming=False)


def record_value(df: DataFrame, *, omit_zero: tuple[str, ...] = ()) -> Column:
    """All columns as one JSON text; listed columns are left out when zero or empty."""
    fields = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in omit_zero:
            absent = F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0)
            c = F.nullif(c, absent)
        fields.append(c.alias(f.name))
    return F.to_json(F.struct(*fields))


# Optional fields of a raw event, absent when zero or empty.
RAW_OPTIONAL = ("price", "best_bid", "best_ask", "size", "side", "old_tick_size", "new_tick_size")


def to_records(df: DataFrame, key: str | None, *, omit_zero: tuple[str, ...] = ()) -> DataFrame:
    key_col = F.col(key).cast("string") if key else F.lit(None).cast("string")
    return df.select(key_col.alias("key"), record_value(df, omit_zero=omit_zero).alias("value"))


def write_topic(
    df: DataFrame, target: str, key: str | None, *, checkpoint: str | None = None,
    omit_zero: tuple[str, ...] = (), once: bool = False,
):
    """Write keyed JSON records; returns the query when ``df`` is a stream."""
    records = to_records(df, key, omit_zero=omit_zero)
    if _is_kafka(target):
        options = _kafka_options(target)
        options["topic"] = options.pop("subscribe")
        options |= {"kafka.acks": "all", "kafka.compression.type": "zstd"}
        fmt, columns = "kafka", records
    else:
        options, fmt, columns = {"path": target}, "text", records.select("value")
    if df.isStreaming:
        writer = columns.writeStream.format(fmt).options(**options).outputMode("append")
        writer = writer.option("checkpointLocation", checkpoint)
        if once:
            writer = writer.trigger(availableNow=True)
        return writer.start()
    columns.write.format(fmt).options(**options).mode("append").save()
    return None


def decode_json_records(df: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split records into decoded rows and a quarantine of undecodable ones.

    Null values (tombstones) are in neither. Absent numbers of the schema stay
    null; see :func:`with_raw_defaults`.
    """
    bad = "_corrupt_record"
    parsed = once(
        df.filter(F.col(value).isNotNull()), "_r",
        F.from_json(value, f"{schema}, {bad} string", {"columnNameOfCorruptRecord": bad}),
    )
    rest = [c for c in df.columns if c != value]
    names = [f.name for f in parsed.schema["_r"].dataType.fields if f.name != bad]
    good = parsed.filter(F.col("_r").isNotNull() & F.col(f"_r.{bad}").isNull()).select(
        *[c for c in rest if c not in names], *[F.col(f"_r.`{n}`").alias(n) for n in names]
    )
    broken = parsed.filter(F.col("_r").isNull() | F.col(f"_r.{bad}").isNotNull()).select(*rest, value)
    return good, broken


def with_raw_defaults(events: DataFrame) -> DataFrame:
    """Absent numbers of a raw event are zero, absent texts empty."""
    numbers = ["price", "best_bid", "best_ask", "size", "old_tick_size", "new_tick_size"]
    texts = ["market_id", "side"]
    fill = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in numbers if c in events.columns}
    fill |= {c: F.coalesce(F.col(c), F.lit("")) for c in texts if c in events.columns}
    return events.withColumns(fill)
