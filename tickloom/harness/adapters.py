"""The test tables seen as feed data.

``events`` plays the price stream, the order tables play frames, markets,
subscriptions and logs. Windows are scaled up: the table has an event every few
minutes, not every few milliseconds.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.params import Params

HOUR = 3_600_000
DAY = 24 * HOUR
P = Params(
    gap_ms=HOUR, ring=50,  # 48 hours and more
    short_ms=6 * HOUR, long_ms=30 * HOUR, hour_ms=48 * HOUR,
    vol_ms=24 * HOUR, threshold=5_000.0, surge_ms=6 * HOUR, cooldown_ms=12 * HOUR,
    snapshot_ms=2 * HOUR, top=3, slice_ms=3 * DAY,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder all executors can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="spark-"), name)


def ms(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events per event type; low values stand for absent numbers."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset_id"),
        F.when(F.col("user_id") < 15, "").otherwise(
            F.concat(F.lit("m"), F.call_function("div", F.col("user_id"), F.lit(15)).cast("string"))
        ).alias("market_id"),
        F.when(v < 1, 0.0).otherwise(v).alias("price"),
        F.when(v < 2, 0.0).otherwise(v - 0.5).alias("best_bid"),
        F.when(v < 3, 0.0).otherwise(v + 0.5).alias("best_ask"),
        ms("ts").alias("recv_ts"), F.col("event_id").alias("ord"),
    )


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of :func:`raw_events` as feed text, with the offset of each frame."""
    rows = raw_events(spark, sf_dir)
    texts = [F.col(c).cast("string").alias(c) for c in ("price", "best_bid", "best_ask")]
    entry = F.struct("asset_id", *texts)
    frame = F.to_json(F.struct(
        F.lit("price_change").alias("event_type"), F.col("market_id").alias("market"),
        F.array(entry).alias("price_changes"), F.col("recv_ts").cast("string").alias("timestamp"),
    ))
    return rows.select(frame.alias("frame"), "recv_ts", F.col("ord").alias("offset"))


def user_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks per user: price, change, sequence and time of each event."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("a"),
        F.col("event_type").alias("m"), F.col("value").alias("p"),
        (F.col("value") - 0.5).alias("b"), (F.col("value") + 0.5).alias("k"),
        (F.col("value") / 10).alias("c1m"), (F.col("value") - 20).alias("c5m"),
        (F.col("value") / 1000).alias("vol"), F.col("event_id").alias("seq"),
        ms("ts").alias("rts"), ms("ts").alias("pts"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded ticks per user: ``ch, id, ts, ord, value``."""
    text = F.concat(
        F.lit('{"a":"u'), F.col("user_id").cast("string"), F.lit('","seq":'),
        F.col("event_id").cast("string"), F.lit("}"),
    )
    return table(spark, sf_dir, "events").select(
        F.lit("asset").alias("ch"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
        ms("ts").alias("ts"), F.col("event_id").alias("ord"), text.alias("value"),
    )


def customer_subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscription interval per customer, ten customers per user of ``events``.

    The balance decides when it starts (days into January) and how long it lasts.
    """
    january = 1_704_067_200_000
    cents = F.floor(F.abs("c_acctbal") * 100).cast("bigint")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), F.lit("asset").alias("ch"),
        F.concat(F.lit("u"), F.call_function("div", F.col("c_custkey"), F.lit(10)).cast("string")).alias("id"),
        (F.lit(january) + cents * 1_000).alias("start"), F.lit(-1).cast("bigint").alias("start_ord"),
        (F.lit(january) + cents * 1_000 + F.col("c_nationkey").cast("bigint") * DAY + HOUR).alias("end"),
        F.lit(-1).cast("bigint").alias("end_ord"),
    )


def customer_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market per customer whose assets are event types."""
    low = F.col("c_nationkey") < 12
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("market_id"),
        F.col("c_name").alias("question"), F.col("c_acctbal").alias("volume"),
        (F.col("c_acctbal") > 0).alias("active"), (F.col("c_nationkey") == 7).alias("closed"),
        F.when(low, F.array(F.col("c_mktsegment"), F.lit("Other"))).otherwise(
            F.array(F.col("c_mktsegment"))
        ).alias("outcomes"),
        F.when(low, F.array(F.lit("click"), F.lit("view"))).otherwise(
            F.array(F.lit("error"), F.lit("signup"), F.lit("purchase"))
        ).alias("clob_token_ids"),
    )


def order_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market per order: its assets are the line numbers, in order.

    A third of the orders (status P) name fewer outcomes than they have assets.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.col("l_linenumber"))).alias("_n")
    )
    asset = F.transform("_n", lambda n: F.concat(
        F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("-"), n.cast("string")))
    label = F.transform("_n", lambda n: F.concat(F.lit("L"), n.cast("string")))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("market_id"), F.col("o_orderpriority").alias("question"),
        F.col("o_totalprice").alias("volume"),
        F.when(F.col("o_orderstatus") == "P", F.slice(label, 1, 1)).otherwise(label).alias("outcomes"),
        asset.alias("clob_token_ids"),
    )


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the order markets' assets: one per line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("a"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("a"),
        F.col("l_extendedprice").alias("p"), F.col("l_tax").alias("b"), F.col("l_discount").alias("k"),
        F.col("l_discount").alias("c1m"), (F.col("l_quantity") - 25).alias("c5m"), F.col("l_tax").alias("vol"),
        (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("seq"), ms("l_shipdate").alias("pts"),
    )


def order_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription operations: a client per customer, the status is the operation."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("client_id"), ms("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("ord"),
        F.when(status == "O", "sub").when(status == "F", "unsub").otherwise("close").alias("op"),
        F.when(F.col("o_totalprice") < 400_000, "asset").otherwise("top").alias("ch"),
        F.when(F.col("o_totalprice") < 200_000, F.array(F.col("o_orderpriority")))
        .otherwise(F.array(F.col("o_orderpriority"), F.lit("1-URGENT"))).alias("ids"),
    )


def user_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription operations of :func:`order_ops` for users' ticks, dealt over January."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("client_id"), (F.lit(1_704_067_200_000) + key * 104_729 % (30 * DAY)).alias("ts"),
        key.alias("ord"),
        F.when(F.col("o_orderstatus") == "O", "sub").when(F.col("o_orderstatus") == "F", "unsub").otherwise("close").alias("op"),
        F.lit("asset").alias("ch"),
        F.array(
            F.concat(F.lit("u"), F.call_function("div", F.col("o_custkey"), F.lit(10)).cast("string")),
            F.concat(F.lit("u"), (key % 1000).cast("string"))).alias("ids"),
    )


def clock(spark: SparkSession, sf_dir: str, ts: int) -> DataFrame:
    """Rows that only say that it is ``ts``."""
    return table(spark, sf_dir, "region").select(F.lit(ts).cast("bigint").alias("ts"))


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording rows ``t, d``: errors are alerts, the rest ticks."""
    stamp = ms("ts").cast("string")
    tick = F.concat(F.lit('{"a":"'), F.col("event_type"), F.lit('","seq":'), F.col("event_id").cast("string"),
                    F.lit(',"pts":'), stamp, F.lit("}"))
    alert = F.concat(F.lit('{"a":"'), F.col("event_type"), F.lit('","ts":'), stamp, F.lit("}"))
    is_alert = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.when(is_alert, "alert").otherwise("tick").alias("t"),
        F.when(is_alert, alert).otherwise(tick).alias("d"),
    )


def book_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book frame per order: its lines are the levels; every third order (status
    P) also carries a last trade."""
    level = F.struct(F.col("l_extendedprice").cast("string").alias("price"),
                     F.col("l_quantity").cast("string").alias("size"))
    books = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.when(F.col("l_linestatus") == "O", level)).alias("bids"),
        F.collect_list(F.when(F.col("l_linestatus") == "F", level)).alias("asks"),
    )
    orders = table(spark, sf_dir, "orders")
    frame = F.to_json(F.struct(
        F.lit("book").alias("event_type"), F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("market"),
        F.col("o_orderkey").cast("string").alias("asset_id"), "bids", "asks",
        ms("o_orderdate").cast("string").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice").cast("string")).alias("last_trade_price"),
    ))
    return orders.join(books, F.col("o_orderkey") == F.col("l_orderkey")).select(
        frame.alias("frame"), F.col("o_orderkey").alias("recv_ts")
    )


def change_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price-change frame per order with one entry per line item."""
    entry = F.struct(
        F.col("l_linenumber").alias("_n"), F.col("l_partkey").alias("_p"), F.col("l_suppkey").alias("_s"),
        F.struct(
            F.col("l_partkey").cast("string").alias("asset_id"),
            F.col("l_extendedprice").cast("string").alias("price"),
            F.col("l_quantity").cast("string").alias("size"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.col("l_discount").cast("string").alias("best_bid"),
            F.col("l_tax").cast("string").alias("best_ask"),
        ).alias("e"),
    )
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("price_changes")
    )
    frame = F.to_json(F.struct(
        F.lit("price_change").alias("event_type"),
        F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("market"), "price_changes",
        F.lit("1700000000000").alias("timestamp"),
    ))
    return grouped.select(frame.alias("frame"), F.col("l_orderkey").alias("recv_ts"))


def mixed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per order by priority: trade, tick size, unknown type in an array,
    heartbeat, and broken text."""
    key = F.col("o_orderkey").cast("string")
    price = F.col("o_totalprice").cast("string")
    head = F.concat(F.lit('{"market":"m'), F.col("o_custkey").cast("string"), F.lit('","asset_id":"'), key,
                    F.lit('","timestamp":"'), ms("o_orderdate").cast("string"), F.lit('",'))
    trade = F.concat(head, F.lit('"event_type":"last_trade_price","price":"'), price,
                     F.lit('","size":"5","side":"BUY"}'))
    size = F.concat(head, F.lit('"event_type":"tick_size_change","old_tick_size":"0.01","new_tick_size":"0.001"}'))
    pair = F.concat(F.lit('[{"event_type":"new_market","id":'), key, F.lit("},"), trade, F.lit("]"))
    torn = F.concat(F.lit("["), trade, F.lit(", 5]"))
    first = F.substring("o_orderpriority", 1, 1)
    frame = (
        F.when(first == "1", trade).when(first == "2", size).when(first == "3", pair)
        .when(first == "4", torn).otherwise(F.lit("PONG"))
    )
    return table(spark, sf_dir, "orders").select(frame.alias("frame"), F.col("o_orderkey").alias("recv_ts"))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue page rows from ``part``; the lists are JSON inside strings."""
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.concat(F.lit("0x"), key).alias("conditionId"), F.col("p_name").alias("question"),
        F.col("p_brand").alias("slug"), F.lit("2026-12-31T00:00:00Z").alias("endDate"),
        F.col("p_retailprice").alias("volumeNum"), (F.col("p_size") > 10).alias("active"),
        (F.col("p_size") > 45).alias("closed"),
        F.when(F.col("p_type") == "SMALL", "").otherwise(
            F.concat(F.lit('["Yes","'), F.col("p_type"), F.lit('"]'))).alias("outcomes"),
        F.concat(F.lit('["'), key, F.lit('1","'), key, F.lit('2"]')).alias("clobTokenIds"),
    )
