"""Exact global order without one big task.

Rows are range-partitioned and sorted, so every row's rank is its position in
its partition plus the size of the partitions before it. The ranged rows are
written once (checkpoint): the partition bounds come from sampling and must not
change between the pass that counts and the pass that numbers.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import durable

_BITS = 33  # monotonically_increasing_id: partition number above, position below
PID, POS = "_pid", "_pos"


def ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` in global order with partition number ``_pid`` and position ``_pos``."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    rows = durable(rows.withColumn("_mid", F.monotonically_increasing_id()))
    mask = (1 << _BITS) - 1
    return rows.select(
        *df.columns, F.shiftright("_mid", _BITS).alias(PID),
        F.col("_mid").bitwiseAND(F.lit(mask)).alias(POS),
    )


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Number the rows 1..n in ``order`` (which must be total for a stable result)."""
    rows = ranged(df, order)
    sizes = rows.groupBy(PID).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(PID, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    # One row per partition of the shuffle: bounded by the partition count.
    return rows.join(F.broadcast(offsets), PID).select(
        *df.columns, (F.col("_off") + F.col(POS) + 1).alias(name)
    )


def nearest_rank_percentile(
    df: DataFrame, value: str, ps: Sequence[float], by: tuple[str, ...] = ()
) -> DataFrame:
    """Exact percentiles: the value of rank ``min(floor(n * p) + 1, n)`` per group.

    Values are first counted per distinct value, then ranged; only the partitions
    that hold a wanted rank are looked into. Columns ``by, p, n, value``.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    rows = ranged(counts, [*by, "value"])
    part = rows.groupBy(*by, PID).agg(F.sum("_c").alias("_in"))
    over = Window.partitionBy(*by).orderBy(PID)
    whole = Window.partitionBy(*by)
    part = part.select(
        *by, PID, "_in",
        F.coalesce(F.sum("_in").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_lo"),
        F.sum("_in").over(whole).alias("n"),
    )
    wanted = (
        part.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
        .withColumn("_rank", F.least(F.floor(F.col("n") * F.col("p")) + 1, F.col("n")))
        .filter((F.col("_rank") > F.col("_lo")) & (F.col("_rank") <= F.col("_lo") + F.col("_in")))
    )
    inside = Window.partitionBy(*by, PID, "p").orderBy("value")
    hit = (
        rows.join(wanted, [*by, PID])
        .withColumn("_upto", F.col("_lo") + F.sum("_c").over(inside))
        .filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank")))
    )
    return hit.select(*by, "p", "n", "value")


def narrowed_percentile(df: DataFrame, value: str, ps: Sequence[float], buckets: int = 1024) -> DataFrame:
    """Exact percentiles of a whole column without moving its values. Columns ``p, n, value``.

    Each round counts the values between the bounds of every open ``p`` in ``buckets`` steps
    and keeps the step that holds the rank, as wide as the values in it: what is shuffled
    is ``buckets`` counts per task and ``p``, however many distinct values there are. A round is a
    scan of one column; doubles need seven or so. Values are doubles or integers below 2 ** 53;
    NaN counts as the largest. No rows if there are no values.
    """
    spark, order = df.sparkSession, F.col(value).cast("double")
    rows = df.filter(F.col(value).isNotNull()).select(order.alias("v"))
    real = rows.filter(~F.isnan("v"))
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("v")).alias("nan"),
        F.min(F.when(~F.isnan("v"), F.col("v"))).alias("lo"), F.max(F.when(~F.isnan("v"), F.col("v"))).alias("hi"),
    ).first()
    n, finite = seen["n"], seen["n"] - seen["nan"]
    bounds, found = {}, {}
    for p in ps if n else ():
        rank = min(int(n * p) + 1, n)
        if rank > finite:
            found[p] = float("nan")
        else:
            bounds[p] = (seen["lo"], seen["hi"], rank)
    while bounds:
        for p in [p for p, (lo, hi, _) in bounds.items() if lo == hi]:
            found[p] = bounds.pop(p)[0]
        if not bounds:
            break
        steps = []
        for p, (lo, hi, _) in bounds.items():
            # halves, so that the distance of two doubles is a double; infinite ends are steps of their own
            low, high = max(lo, -1.7976931348623157e308), min(hi, 1.7976931348623157e308)
            share = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2) if high / 2 > low / 2 else F.when(F.col("v") > low, 1.0).otherwise(0.0)
            inner = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("bigint")
            step = F.when(F.col("v") < low, -1).when(F.col("v") > high, buckets).otherwise(inner)
            steps.append(F.when(F.col("v").between(lo, hi), F.struct(F.lit(p).alias("p"), step.cast("bigint").alias("s"))))
        counted = real.select("v", F.explode(F.array_compact(F.array(*steps))).alias("_a")).groupBy("_a.p", "_a.s").agg(
            F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rest = {p: rank for p, (_, _, rank) in bounds.items()}
        for r in sorted(counted.collect(), key=lambda r: (r["p"], r["s"])):  # at most buckets + 2 rows per p
            if 0 < rest[r["p"]] <= r["c"]:
                bounds[r["p"]] = (r["lo"], r["hi"], rest[r["p"]])
            rest[r["p"]] -= r["c"]
    return spark.createDataFrame([(float(p), n, found[p]) for p in ps if p in found], "p double, n bigint, value double")


def assign_chunks(ids: DataFrame, size: int, id_col: str = "asset_id") -> DataFrame:
    """Sorted distinct ids in chunks of at most ``size``; ``size <= 0`` is one chunk."""
    numbered = global_rank(ids.select(id_col).distinct(), [id_col], "position")
    chunk = F.lit(0).cast("bigint") if size <= 0 else F.call_function(
        "div", F.col("position") - 1, F.lit(size).cast("bigint")
    )
    return numbered.withColumn("chunk", chunk)


def tail_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Last ``n`` rows of ``order`` (top-n per task, then merged)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
