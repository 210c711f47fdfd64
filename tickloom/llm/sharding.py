"""Contiguous shards of equal byte size, from global prefix sums.

Only DataFrame functions. The texts are read once; what moves is a narrow row per
document (id, size, checksums). Documents are put in the order of a hash of their
text and then their id, so equal texts stand next to each other, and the order is cut at
equal byte targets: shard ``s`` of ``k`` takes the rows whose bytes before them fall into
``[s, s + 1) * total / k``.

A group of equal texts goes whole to the shard its first byte falls into, unless
it holds more than ``1 / SPLIT`` of a shard; such a group is cut by row. Shard sizes
thus differ from the target by that share or one document at most.

Defined results: a null text counts as no bytes (size 1, checksum 0); repeated rows
are rows of their own; a null id sorts first; an empty table gives no rows. Other
columns of the input are ignored, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ranks import PID, ranged
from tickloom.session import durable

#: A group of equal texts above 1/256 of a shard is cut by row.
SPLIT = 256


def shard_by_bytes(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT
) -> DataFrame:
    """One row per document: id, ``size, text_crc32, shard, slot``.

    ``slot`` numbers the rows of a shard from 0 in the global order.
    """
    text = F.col(text_col)
    narrow = durable(docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("key"),
    ))
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    # Fewer than shards * split groups can be above the limit: the broadcast is bounded.
    large = (
        narrow.groupBy("key").agg(F.sum("size").alias("bytes"))
        .filter(F.col("bytes") * (shards * split) > F.lit(total)).select("key", F.lit(True).alias("large"))
    )
    rows = (
        narrow.join(F.broadcast(large), "key", "left")
        .withColumn("large", F.coalesce("large", F.lit(False)))
        .withColumn("at", F.when(F.col("large"), F.struct(F.col("id"), F.monotonically_increasing_id().alias("m"))))
    )
    # Rows of a large group are told apart by `at`, so its bytes spread over many ranges.
    placed = ranged(rows, ["key", "at"])
    inside = Window.partitionBy(PID).orderBy("key", "at", "id")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(PID).agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many as the shuffle has partitions.
    offsets = sums.select(
        PID, F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
    )
    group = Window.partitionBy(PID, "key").orderBy("at", "id")
    global_rows = (
        placed.withColumn("_place", F.row_number().over(inside))
        .withColumn("_in", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .withColumn("_start", F.when(F.col("large"), F.col("_in")).otherwise(F.first("_in").over(group)))
        .join(F.broadcast(offsets), PID)
        .withColumn("_rank", F.col("_row0") + F.col("_place") - 1)
        .withColumn("shard", F.call_function(
            "div", (F.col("_byte0") + F.col("_start")) * F.lit(shards), F.lit(max(total, 1)).cast("bigint"),
        ).cast("int"))
    )
    kept = durable(global_rows.select("id", "size", "text_crc32", "shard", "_rank"))
    first = kept.groupBy("shard").agg(F.min("_rank").alias("_first"))
    return kept.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard",
        (F.col("_rank") - F.col("_first")).alias("slot"),
    )
