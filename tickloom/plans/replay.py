"""From a recording to a replay clip: pick the busiest hour, trim it, describe it."""
from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numbers import iso_millis, whole_seconds
from tickloom.operators.catalog import trailing_duration
from tickloom.operators.ranks import global_rank

#: Lines of one gzip member.
BLOCK = 10_000


def alert_density(lines: DataFrame, by: tuple[str, ...] = ("date", "hour")) -> DataFrame:
    """Alerts per recorded hour."""
    return lines.groupBy(*by).agg(F.count_if(F.col("kind") == "alert").alias("alerts"))


def densest(density: DataFrame, by: tuple[str, ...] = ("date", "hour")) -> DataFrame:
    """The hour with most alerts, the first one on ties."""
    return density.orderBy(F.col("alerts").desc(), *by).limit(1)


def order_recording(rows: DataFrame, order: tuple[str, ...] = ("ts", "file", "pos")) -> DataFrame:
    return rows.orderBy(*order)


def gzip_size(lines: list[bytes]) -> int:
    """Bytes of the lines as one gzip member."""
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    return sum(len(packer.compress(line)) for line in lines) + len(packer.flush())


def raw_size(lines: list[bytes]) -> int:
    return sum(map(len, lines))


def trim_to_budget(
    rows: DataFrame, max_bytes: int, order: tuple[str, ...] = ("ts", "file", "pos"),
    measure: Callable[[list[bytes]], int] = gzip_size, block: int = BLOCK,
) -> DataFrame:
    """Newest lines whose size fits: the first of n, 9/10 n, ... that does, never fewer
    than one line.

    Sizes are taken per block of ``block`` lines counted from the newest, each packed as
    a gzip member of its own (members joined together are one valid file), and added up;
    so they depend on the lines alone, not on the partitions. A member costs about twenty
    bytes and starts with an empty dictionary: with the default the sum is within a few
    per cent of one stream's size, and never below what the joined file takes. All cuts
    are measured in one pass over the lines.
    """
    numbered = global_rank(rows, order, "_rank")
    total = numbered.count()
    cuts = [total]
    while cuts[-1] > 1:
        cuts.append(max(cuts[-1] * 9 // 10, 1))
    inside: dict[int, list[int]] = {}
    for keep in cuts:  # lines of its oldest block that a cut keeps
        inside.setdefault((keep - 1) // block, []).append((keep - 1) % block + 1)

    def sizes(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["_block"].iloc[0])
        lines = [line.encode() + b"\n" for line in pdf.sort_values("_rank")["line"]]
        wanted = sorted({len(lines), *inside.get(number, [])})
        return pd.DataFrame({
            "block": number, "keep": wanted, "size": [measure(lines[len(lines) - k:]) for k in wanted],
        })

    numbered = numbered.withColumn("_block", F.floor((F.lit(total) - F.col("_rank")) / block))
    measured = numbered.select("_block", "_rank", "line").groupBy("_block").applyInPandas(
        sizes, "block bigint, keep bigint, size bigint"
    )
    full = F.col("keep") == F.least(F.lit(block), F.lit(total) - F.col("block") * block)

    def size_of(keep: int) -> Column:
        oldest, part = (keep - 1) // block, (keep - 1) % block + 1
        within = (F.col("block") == oldest) & (F.col("keep") == part)
        return F.sum(F.when(within | (full & (F.col("block") < oldest)), F.col("size")))

    # one row: a cut is a column, about 22 for each power of ten lines
    found = measured.agg(*[size_of(keep).alias(str(i)) for i, keep in enumerate(cuts)]).first() if total else []
    kept = next((keep for keep, size in zip(cuts, found) if size <= max_bytes), cuts[-1])
    return numbered.filter(F.col("_rank") > total - kept).drop("_rank", "_block")


def clip_stats(rows: DataFrame) -> DataFrame:
    """Start of the clip and its length, from the events' own times."""
    return rows.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b")).select(
        iso_millis("_a").alias("recorded_at"), whole_seconds(F.col("_b") - F.col("_a")).alias("duration_s")
    )


def manifest(stats: DataFrame, files: list[str]) -> DataFrame:
    return stats.select(
        "recorded_at", "duration_s", F.array(*[F.lit(f) for f in files]).alias("files"),
        F.lit("markets.json").alias("markets"), F.lit("benchmark.json").alias("benchmark"),
    )


def clip_name(date: str, hour: str) -> str:
    return f"replay-{date}-{hour}.ndjson.gz"


def extract_clip(
    lines: DataFrame, *, max_ms: int = 3_600_000, max_bytes: int = 5 * 1024 * 1024,
    measure: Callable[[list[bytes]], int] = gzip_size,
) -> tuple[DataFrame, DataFrame]:
    """``(clip rows, manifest row)`` of the densest hour of a recording."""
    best = densest(alert_density(lines)).first()
    hour = lines.filter((F.col("date") == F.lit(best["date"])) & (F.col("hour") == F.lit(best["hour"])))
    clip = trim_to_budget(trailing_duration(hour, "ts", max_ms), max_bytes, measure=measure)
    name = clip_name(str(best["date"]), f"{int(best['hour']):02d}")
    return clip, manifest(clip_stats(clip), [name])


def due(elapsed: Column, speed: float = 1.0, changes: tuple[tuple[float, float], ...] = ()) -> Column:
    """Playing time in milliseconds at which ``elapsed`` recorded milliseconds have passed.

    ``changes`` are ``(from playing ms, speed)`` steps.
    """
    steps = sorted([(0.0, float(speed)), *[(float(a), float(b)) for a, b in changes]])
    out, done = None, 0.0
    for (at, pace), (nxt, _) in zip(steps, [*steps[1:], (0.0, 0.0)]):
        value = F.lit(at) + (elapsed - F.lit(done)) / F.lit(pace)
        out = value if out is None else F.when(elapsed >= F.lit(done), value).otherwise(out)
        done += (nxt - at) * pace
    return out


def replay_schedule(
    rows: DataFrame, speed: float = 1.0, laps: int = 1, changes: tuple[tuple[float, float], ...] = ()
) -> DataFrame:
    """When each event is due, in milliseconds of playing time, looping ``laps`` times.

    The clip's first event is due at 0 and a lap starts when the one before it has
    played out. ``changes`` are ``(from playing ms, speed)`` steps inside a lap.
    """
    origin = rows.agg(F.min("ts")).scalar()
    span = rows.agg(F.max("ts") - F.min("ts")).scalar()
    lap = F.explode(F.sequence(F.lit(0), F.lit(laps - 1))).alias("lap")
    return rows.select("*", lap, (F.col("ts") - origin).cast("double").alias("_e")).select(
        *rows.columns, "lap",
        (due(F.col("_e"), speed, changes) + F.col("lap") * due(span.cast("double"), speed, changes)).alias("due_ms"),
    )
