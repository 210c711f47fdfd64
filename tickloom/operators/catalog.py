"""Lists of markets and alerts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numbers import intensity
from tickloom.functions.text import truncate
from tickloom.operators.joins import latest_tick_view


def active_markets(markets: DataFrame) -> DataFrame:
    return markets.filter(F.col("active") & ~F.col("closed"))


def with_assets(markets: DataFrame) -> DataFrame:
    return markets.filter(F.size("clob_token_ids") > 0)


def top_n_markets(markets: DataFrame, n: int) -> DataFrame:
    """Largest volume first, ties by id; ``n <= 0`` keeps all."""
    ordered = markets.orderBy(F.col("volume").desc(), "market_id")
    return ordered.limit(n) if n > 0 else ordered


def market_wall(markets: DataFrame, ticks: DataFrame, n: int = 100) -> DataFrame:
    """Tiles: the top markets that have assets, with the state of their first asset."""
    top = top_n_markets(with_assets(markets), n)
    return latest_tick_view(top, ticks).withColumns({
        "title": truncate("question", 60), "heat": intensity("c5m"),
    }).orderBy(F.col("volume").desc(), "market_id")


def recent_alerts(alerts: DataFrame, n: int = 50, order: tuple[str, ...] = ("ts", "a")) -> DataFrame:
    return alerts.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def resort_top(top: DataFrame) -> DataFrame:
    """Entries of each top record by ``|c5m|`` descending, ties by asset."""
    entry = F.transform(
        "d", lambda e: F.struct((-F.abs(e["c5m"])).alias("s"), e["a"].alias("a"), e["c5m"].alias("c5m"))
    )
    return top.withColumn(
        "d", F.transform(F.array_sort(entry), lambda e: F.struct(e["a"].alias("a"), e["c5m"].alias("c5m")))
    )


def diff_assets(old: DataFrame, new: DataFrame, id_col: str = "asset_id") -> DataFrame:
    """Every id of either set with ``added``, ``removed`` or ``kept``."""
    a = old.select(id_col).distinct().withColumn("_old", F.lit(True))
    b = new.select(id_col).distinct().withColumn("_new", F.lit(True))
    status = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept")
    )
    return a.join(b, id_col, "full").select(id_col, status.alias("status"))


def retain(df: DataFrame, ts: str, as_of: int, keep_ms: int) -> DataFrame:
    """Rows younger than ``keep_ms`` at ``as_of`` (a literal bound, so it is pushed down)."""
    return df.filter(F.col(ts) > as_of - keep_ms)


def trailing_duration(df: DataFrame, ts: str, keep_ms: int) -> DataFrame:
    """Rows within ``keep_ms`` of the newest one."""
    newest = df.agg(F.max(ts).alias("t")).scalar()
    return df.filter(F.col(ts) >= newest - keep_ms)


def only_kind(df: DataFrame, kind: str, column: str = "t") -> DataFrame:
    return df.filter(F.col(column) == kind)


def union_streams(ticks: DataFrame, alerts: DataFrame, value: str = "value") -> DataFrame:
    """Ticks and alerts as one stream of ``t, d``."""
    return ticks.select(F.lit("tick").alias("t"), F.col(value).alias("d")).unionByName(
        alerts.select(F.lit("alert").alias("t"), F.col(value).alias("d"))
    )
