"""As-of joins, skew-aware equi-joins and market enrichment."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.axis import Axis, running
from tickloom.operators.keyed import latest_per_key
from tickloom.schemas import RECORD_VERSION

def asof_join(
    left: DataFrame, right: DataFrame, by: tuple[str, ...], left_ts: str, right_ts: str, *,
    left_order: tuple[str, ...] = (), right_order: tuple[str, ...] = (), width: int = 900_000,
    hit: str = "hit",
) -> DataFrame:
    """Each left row with the newest right row of its key at or before its time.

    ``hit`` is a struct of the right row's other columns, null when there is none.
    Both sides go through one sliced pass; on equal times right rows come first,
    then ``*_order`` decides. Rows are never joined pairwise.
    """
    payload = [c for c in right.columns if c not in by]

    def side(df: DataFrame, n: int, ts: str, order: tuple[str, ...]) -> DataFrame:
        tie = F.struct(*[F.col(c).cast("bigint").alias(f"o{i}") for i, c in enumerate(order)]) if order \
            else F.struct(F.lit(0).cast("bigint").alias("o0"))
        return df.select(
            *by, F.col(ts).cast("bigint").alias("_t"), F.lit(n).alias("_side"), tie.alias("_tie"),
            (F.struct(*payload) if n == 0 else F.lit(None)).alias("_right"),
            (F.struct(*[c for c in df.columns]) if n == 1 else F.lit(None)).alias("_left"),
        )

    size = max(len(left_order), len(right_order), 1)

    def padded(df: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
        extra = {f"_z{i}": F.lit(0).cast("bigint") for i in range(size - len(order))}
        return (df.withColumns(extra) if extra else df), (*order, *extra)

    lefts, lo = padded(left, left_order)
    rights, ro = padded(right, right_order)
    both = side(rights, 0, right_ts, ro).unionByName(side(lefts, 1, left_ts, lo))
    rows = running(
        both, Axis(by, ("_t", "_side", "_tie"), width), lasts={hit: F.col("_right")}
    )
    return rows.filter(F.col("_side") == 1).select(
        *[F.col(f"_left.`{c}`").alias(c) for c in left.columns], hit
    )


def hot_keys(df: DataFrame, on: tuple[str, ...], most: int = 1_000_000) -> DataFrame:
    """Keys with more than ``most`` rows and the number of parts each needs."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(
        *on, F.ceil(F.col("_n") / most).cast("int").alias("parts")
    )


def skew_join(
    left: DataFrame, right: DataFrame, on: tuple[str, ...], *, spread: tuple[str, ...],
    hot: DataFrame | None = None, condition: Column | None = None, how: str = "inner",
) -> DataFrame:
    """Equi-join on ``on``; left rows of hot keys are spread over ``parts`` tasks.

    The part of a left row is a hash of its ``spread`` columns, and right rows of
    hot keys are repeated once per part. How the hot-key table is joined is left to
    Spark, which knows its size at run time. Without ``hot`` the join relies on
    adaptive skew splitting.
    """
    if hot is None:
        joined = left.join(right, list(on), how)
        return joined if condition is None else joined.filter(condition)
    parts = F.coalesce("parts", F.lit(1))
    lefts = left.join(hot, list(on), "left").withColumn(
        "_part", F.pmod(F.xxhash64(*spread), parts.cast("bigint")).cast("int")
    ).drop("parts")
    rights = right.join(hot, list(on), "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    ).drop("parts")
    joined = lefts.join(rights, [*on, "_part"], how).drop("_part")
    return joined if condition is None else joined.filter(condition)


def outcome_for(asset: str, outcomes: str = "outcomes", ids: str = "clob_token_ids") -> Column:
    """Outcome label of an asset inside its market, ``""`` when unknown."""
    at = F.array_position(F.col(ids), F.col(asset))
    label = F.try_element_at(F.col(outcomes), F.when(at > 0, at.cast("int")))
    return F.coalesce(label, F.lit(""))


def latest_markets(markets: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    if not order:
        return markets
    return latest_per_key(markets, ("market_id",), order).drop(*order)


def enrich_alerts(
    alerts: DataFrame, markets: DataFrame, *, order: tuple[str, ...] = (), as_of: bool = False
) -> DataFrame:
    """Alerts with the question and outcome of their market, ``""`` when missing.

    ``order`` picks the newest version per market when ``markets`` is a change
    log. With ``as_of`` the version known at the alert's time is used, and
    ``order[0]`` is the version's time.
    """
    need = ["market_id", "question", "outcomes", "clob_token_ids"]
    if as_of:
        rows = asof_join(
            alerts, markets.select(*need, *order), ("market_id",), "recv_ts", order[0],
            left_order=("ord",), right_order=order[1:], hit="_m",
        ).select(*alerts.columns, "_m.question", "_m.outcomes", "_m.clob_token_ids")
    else:
        newest = latest_markets(markets.select(*need, *order), order)
        rows = alerts.join(newest, "market_id", "left")
    return rows.select(
        *alerts.columns, F.coalesce("question", F.lit("")).alias("question"),
        outcome_for("asset_id").alias("outcome"),
    )


def as_alerts(surges: DataFrame, window_s: int) -> DataFrame:
    """Enriched surges in the alert layout."""
    return surges.select(
        F.lit(RECORD_VERSION).alias("v"), F.col("asset_id").alias("a"), F.col("market_id").alias("m"),
        F.col("question").alias("q"), "outcome", "from", "to",
        F.lit(window_s).alias("window_s"), F.col("recv_ts").alias("ts"),
    )


def asset_ids(markets: DataFrame) -> DataFrame:
    return markets.select("market_id", F.explode("clob_token_ids").alias("asset_id"))


def explode_assets(markets: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """One row per outcome of each market: asset, its index and label."""
    extra = [c for c in order if c not in ("market_id", "question")]
    rows = markets.select(
        "market_id", "question", *extra, "outcomes",
        F.posexplode("clob_token_ids").alias("idx", "asset_id"),
    )
    label = F.try_element_at("outcomes", F.col("idx") + 1)
    named = F.concat(F.lit("Outcome "), (F.col("idx") + 1).cast("string"))
    return rows.withColumn("outcome", F.coalesce(label, named)).drop("outcomes")


def asset_market_lookup(markets: DataFrame, order: tuple[str, ...] = ("market_id",)) -> DataFrame:
    """Asset to market. The later market (by ``order``) wins a shared asset."""
    exploded = explode_assets(markets, order)
    return latest_per_key(exploded, ("asset_id",), (*order, "idx"))


def latest_ticks(ticks: DataFrame) -> DataFrame:
    return latest_per_key(ticks, ("a",), ("pts", "seq"))


def latest_tick_view(markets: DataFrame, ticks: DataFrame) -> DataFrame:
    """Markets with the newest tick of their first asset; zeros when there is none."""
    first = markets.withColumn("asset_id", F.try_element_at("clob_token_ids", F.lit(1)))
    newest = latest_ticks(ticks).select(
        F.col("a").alias("asset_id"), "p", F.col("c5m").alias("_c5m")
    )
    return first.join(newest, "asset_id", "left").select(
        "market_id", "question", "volume", "asset_id", F.col("p").isNotNull().alias("has_tick"),
        F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("_c5m", F.lit(0.0)).alias("c5m"),
    )


def market_detail(markets: DataFrame, ticks: DataFrame) -> DataFrame:
    """Every outcome of the markets with its newest tick; nulls when there is none."""
    newest = latest_ticks(ticks).select(
        F.col("a").alias("asset_id"), "p", "b", "k", "c1m", "c5m", "vol"
    )
    return explode_assets(markets).join(newest, "asset_id", "left")


def alerts_question(alerts: DataFrame, markets: DataFrame, order: tuple[str, ...] = ("market_id",)) -> DataFrame:
    """Alert question from the asset's market, else the alert's own."""
    lookup = asset_market_lookup(markets, order).select(
        F.col("asset_id").alias("a"), F.col("question").alias("_q")
    )
    return alerts.join(lookup, "a", "left").withColumn("q", F.coalesce("_q", "q")).drop("_q")
