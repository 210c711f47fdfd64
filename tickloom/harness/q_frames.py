"""Frames, record decoding, markets and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import numbers, text, wire
from tickloom.harness.adapters import (
    book_frames, change_frames, customer_markets, mixed_frames, ms, order_markets, part_pages, scratch, table,
)
from tickloom.harness.registry import query, r6
from tickloom.operators import catalog, joins
from tickloom.operators.ranks import global_rank
from tickloom.sources import frames, markets, topics

COLS = ["pos", "sub", "v", "src", "kind", "asset_id", "market_id", "price", "best_bid", "best_ask",
        "size", "side", "old_tick_size", "new_tick_size", "src_ts", "recv_ts"]


def event_output(df):
    return df.select(
        F.col("pos").cast("bigint").alias("pos"), F.col("sub").cast("bigint").alias("sub"),
        F.col("v").cast("bigint").alias("v"), "src", "kind", "asset_id", "market_id",
        r6("price"), r6("best_bid"), r6("best_ask"), r6("size"), "side", "old_tick_size",
        "new_tick_size", "src_ts", "recv_ts",
    )


BOOK_SQL = """
select cast(0 as bigint) as pos, cast(0 as bigint) as sub, cast(1 as bigint) as v, 'polymarket' as src, 'book' as kind,
  cast(o_orderkey as varchar) as asset_id, 'm' || o_custkey as market_id,
  round(case when o_orderstatus = 'P' then o_totalprice when bid > 0 and ask > 0 then (bid + ask) / 2 else 0 end, 6) as price,
  round(bid, 6) as best_bid, round(ask, 6) as best_ask, 0.0::double as size, '' as side,
  0.0::double as old_tick_size, 0.0::double as new_tick_size,
  epoch_us(o_orderdate) // 1000 as src_ts, o_orderkey as recv_ts
from orders join (
  select l_orderkey, coalesce(max(case when l_linestatus = 'O' then l_extendedprice end), 0) as bid,
         coalesce(min(case when l_linestatus = 'F' then l_extendedprice end), 0) as ask
  from lineitem group by 1) on o_orderkey = l_orderkey"""


@query("parse_book", BOOK_SQL)
def parse_book(spark, sf_dir):
    elements, _ = frames.decode_frames(book_frames(spark, sf_dir))
    return event_output(frames.parse_book(elements))


@query("parse_frames_books", BOOK_SQL)
def parse_frames_books(spark, sf_dir):
    return event_output(frames.parse_frames(book_frames(spark, sf_dir)))


CHANGE_SQL = """
select cast(0 as bigint) as pos,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as sub,
  cast(1 as bigint) as v, 'polymarket' as src, 'quote' as kind, cast(l_partkey as varchar) as asset_id,
  'm' || l_orderkey as market_id, round(l_extendedprice, 6) as price, round(l_discount, 6) as best_bid,
  round(l_tax, 6) as best_ask, round(l_quantity, 6) as size,
  case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side, 0.0::double as old_tick_size,
  0.0::double as new_tick_size, 1700000000000 as src_ts, l_orderkey as recv_ts
from lineitem"""


@query("parse_price_change", CHANGE_SQL)
def parse_price_change(spark, sf_dir):
    elements, _ = frames.decode_frames(change_frames(spark, sf_dir))
    return event_output(frames.parse_price_change(elements))


def mixed_sql(kinds: str, where: str) -> str:
    return f"""
select cast(case when p = '3' then 1 else 0 end as bigint) as pos, cast(0 as bigint) as sub, cast(1 as bigint) as v,
  'polymarket' as src, case when p = '2' then 'tick_size_change' else 'trade' end as kind,
  cast(o_orderkey as varchar) as asset_id, 'm' || o_custkey as market_id,
  round(case when p = '2' then 0 else o_totalprice end, 6) as price, 0.0::double as best_bid, 0.0::double as best_ask,
  case when p = '2' then 0.0 else 5.0 end::double as size, case when p = '2' then '' else 'BUY' end as side,
  case when p = '2' then 0.01 else 0.0 end::double as old_tick_size,
  case when p = '2' then 0.001 else 0.0 end::double as new_tick_size,
  epoch_us(o_orderdate) // 1000 as src_ts, o_orderkey as recv_ts
from (select *, substr(o_orderpriority, 1, 1) as p from orders) where {where}"""


@query("parse_frames", mixed_sql("", "p in ('1', '2', '3')"))
def parse_frames(spark, sf_dir):
    return event_output(frames.parse_frames(mixed_frames(spark, sf_dir)))


@query("parse_last_trade", mixed_sql("", "p in ('1', '3')"))
def parse_last_trade(spark, sf_dir):
    elements, _ = frames.decode_frames(mixed_frames(spark, sf_dir))
    return event_output(frames.parse_last_trade(elements))


@query("parse_tick_size_change", mixed_sql("", "p = '2'"))
def parse_tick_size_change(spark, sf_dir):
    elements, _ = frames.decode_frames(mixed_frames(spark, sf_dir))
    return event_output(frames.parse_tick_size_change(elements))


@query("rejected_frames", "select o_orderkey as recv_ts from orders where o_orderpriority like '4%'")
def rejected_frames(spark, sf_dir):
    _, rejected = frames.decode_frames(mixed_frames(spark, sf_dir))
    return rejected.select("recv_ts")


@query("unknown_types", "select o_orderkey as recv_ts, 'new_market' as event_type from orders where o_orderpriority like '3%'")
def unknown_types(spark, sf_dir):
    elements, _ = frames.decode_frames(mixed_frames(spark, sf_dir))
    return frames.unknown_types(elements).select("recv_ts", F.col("e.event_type").alias("event_type"))


@query("filter_heartbeats", "select o_orderkey as recv_ts from orders where o_orderpriority not like '5%'")
def filter_heartbeats(spark, sf_dir):
    return frames.filter_heartbeats(mixed_frames(spark, sf_dir)).select("recv_ts")


# Spellings a lenient cast would accept (a type suffix, blanks) must give zero.
SPELLED = """case l_linenumber when 1 then cast(l_extendedprice as varchar) when 2 then l_extendedprice || 'd'
  when 3 then ' ' || l_extendedprice when 4 then '' when 5 then '+' || l_partkey when 6 then '-' || l_partkey
  else 'n/a' end"""


def spelled():
    price, part = F.col("l_extendedprice").cast("string"), F.col("l_partkey").cast("string")
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, price).when(n == 2, F.concat(price, F.lit("d"))).when(n == 3, F.concat(F.lit(" "), price))
        .when(n == 4, "").when(n == 5, F.concat(F.lit("+"), part)).when(n == 6, F.concat(F.lit("-"), part))
        .otherwise("n/a")
    )


@query("num_or_zero", """select l_orderkey, l_linenumber, l_partkey, round(case l_linenumber
  when 1 then l_extendedprice when 5 then l_partkey when 6 then -l_partkey else 0 end, 6)::double as value from lineitem""")
def num_or_zero(spark, sf_dir):
    value = F.round(numbers.num_or_zero(spelled()), 6) + 0.0
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", value.alias("value"))


@query("int_or_zero", """select l_orderkey, l_linenumber, l_partkey, case l_linenumber
  when 5 then l_partkey when 6 then -l_partkey else 0 end::bigint as value from lineitem""")
def int_or_zero(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", numbers.int_or_zero(spelled()).alias("value"))


MARKET_SQL = """
select cast(1 as bigint) as v, '0x' || p_partkey as market_id, p_name as question, p_brand as slug,
  '2026-12-31T00:00:00Z' as end_date, round(p_retailprice, 6) as volume, p_size > 10 as active, p_size > 45 as closed,
  coalesce(case when p_type = 'SMALL' then null else 'Yes|' || p_type end, '-') as outcomes,
  p_partkey || '1|' || p_partkey || '2' as clob_token_ids from part"""


def market_output(df):
    return df.select(
        F.col("v").cast("bigint").alias("v"), "market_id", "question", "slug", "end_date", r6("volume"), "active",
        "closed", F.coalesce(F.array_join("outcomes", "|"), F.lit("-")).alias("outcomes"),
        F.array_join("clob_token_ids", "|").alias("clob_token_ids"),
    )


@query("normalize_markets", MARKET_SQL)
def normalize_markets(spark, sf_dir):
    return market_output(markets.normalize_markets(part_pages(spark, sf_dir)))


@query("normalize_markets_permissive", """select '0x' || p_partkey as market_id, p_type is not null and p_type = 'LARGE' as broken,
  case when p_type = 'LARGE' then 'outcomes' end as error from part""")
def normalize_markets_permissive(spark, sf_dir):
    pages = part_pages(spark, sf_dir).withColumn(
        "outcomes", F.when(F.col("outcomes").contains("LARGE"), '["Yes"').otherwise(F.col("outcomes")))
    rows = markets.normalize_markets(pages, "permissive")
    return rows.select("market_id", (F.col("outcomes").isNull() & F.col("error").isNotNull()).alias("broken"), "error")


@query("read_markets_catalog", MARKET_SQL + " where p_size > 10 and not p_size > 45")
def read_markets_catalog(spark, sf_dir):
    """Pages of 500 markets, written as files of JSON arrays, then read back."""
    pages = part_pages(spark, sf_dir)
    folder = scratch(spark, "pages")
    numbered = global_rank(pages, ["id"], "n").withColumn("page", F.floor((F.col("n") - 1) / 500))
    one = numbered.groupBy("page").agg(F.to_json(F.collect_list(F.struct(*pages.columns))).alias("value"))
    one.repartition("page").select("page", "value").write.partitionBy("page").text(folder)
    return market_output(markets.read_markets_catalog(spark, folder + "/*"))


@query("active_markets", "select p_partkey as id from part where p_size > 10 and not p_size > 45")
def active_markets(spark, sf_dir):
    return catalog.active_markets(part_pages(spark, sf_dir)).select(F.col("id").cast("bigint").alias("id"))


@query("with_assets", """select o_orderkey as market_id from orders where o_orderkey in (select l_orderkey from lineitem)""")
def with_assets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("_n"))
    all_orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("market_id"),
        F.coalesce("_n", F.array().cast("array<int>")).alias("clob_token_ids"))
    return catalog.with_assets(all_orders).select("market_id")


LINES = """li as (select l_orderkey as k, l_linenumber as n,
  row_number() over (partition by l_orderkey order by l_linenumber) - 1 as idx
  from (select distinct l_orderkey, l_linenumber from lineitem))"""


@query("asset_ids", f"with {LINES} select k as market_id, 'a' || k || '-' || n as asset_id from li join orders on k = o_orderkey")
def asset_ids(spark, sf_dir):
    return joins.asset_ids(order_markets(spark, sf_dir))


ASSETS_SQL = f"""with {LINES} select k as market_id, o_orderpriority as question, idx, 'a' || k || '-' || n as asset_id,
  case when o_orderstatus = 'P' and idx > 0 then 'Outcome ' || (idx + 1) else 'L' || n end as outcome
from li join orders on k = o_orderkey"""


@query("explode_assets", ASSETS_SQL)
def explode_assets(spark, sf_dir):
    return joins.explode_assets(order_markets(spark, sf_dir)).withColumn("idx", F.col("idx").cast("bigint"))


@query("outcome_for", f"""with {LINES} select k as market_id, 'a' || k || '-' || n as asset_id,
  case when o_orderstatus = 'P' and idx > 0 then '' else 'L' || n end as outcome from li join orders on k = o_orderkey""")
def outcome_for(spark, sf_dir):
    rows = order_markets(spark, sf_dir).withColumn("asset_id", F.explode("clob_token_ids"))
    return rows.select("market_id", "asset_id", joins.outcome_for("asset_id").alias("outcome"))


@query("asset_market_lookup", """with mk as (
  select c_custkey, c_name, c_mktsegment, unnest(case when c_nationkey < 12 then ['click', 'view']
    else ['error', 'signup', 'purchase'] end) as asset_id, c_nationkey < 12 as low from customer)
select asset_id, 'm' || c_custkey as market_id, c_name as question from mk
qualify row_number() over (partition by asset_id order by c_name desc) = 1""")
def asset_market_lookup(spark, sf_dir):
    rows = joins.asset_market_lookup(customer_markets(spark, sf_dir), ("question",))
    return rows.select("asset_id", "market_id", "question")


@query("market_export", """select 'm' || c_custkey as market_id, c_name as question, round(c_acctbal, 6) as volume,
  c_acctbal > 0 as active, c_nationkey = 7 as closed,
  case when c_nationkey < 12 then c_mktsegment || ',Other' else c_mktsegment end as outcomes,
  case when c_nationkey < 12 then 'click,view' else 'error,signup,purchase' end as ids from customer""")
def market_export(spark, sf_dir):
    """Every field of the exported text."""
    rows = markets.market_export(customer_markets(spark, sf_dir))
    back = F.from_json("value", "market_id string, question string, volume double, active boolean, closed boolean, "
                       "outcomes array<string>, clob_token_ids array<string>")
    return rows.select("market_id", back.alias("x")).filter("market_id = x.market_id").select(
        "market_id", "x.question", r6("x.volume", "volume"), "x.active", "x.closed",
        F.array_join("x.outcomes", ",").alias("outcomes"), F.array_join("x.clob_token_ids", ",").alias("ids"))


# --- records -------------------------------------------------------------
def order_records(spark, sf_dir):
    """Order records as JSON text: status F is cut short, status P is a tombstone."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("asset_id_n"), F.col("o_orderpriority").alias("kind"),
        F.col("o_custkey").alias("src_ts"), "o_orderstatus")
    json = F.to_json(F.struct(F.col("asset_id_n").cast("string").alias("asset_id"), "kind", "src_ts"))
    value = F.when(F.col("o_orderstatus") == "F", F.expr("substring(_j, 1, length(_j) - 3)")).when(
        F.col("o_orderstatus") == "O", F.col("_j"))
    return rows.withColumn("_j", json).select(F.col("asset_id_n").alias("key"), value.alias("value"))


@query("decode_json_records", """select o_orderkey as key, cast(o_orderkey as varchar) as asset_id, o_orderpriority as kind,
  o_custkey as src_ts from orders where o_orderstatus = 'O'""")
def decode_json_records(spark, sf_dir):
    good, _ = topics.decode_json_records(order_records(spark, sf_dir), schemas.RAW_EVENT)
    return good.select("key", "asset_id", "kind", "src_ts")


@query("quarantined_records", "select o_orderkey as key from orders where o_orderstatus = 'F'")
def quarantined_records(spark, sf_dir):
    _, bad = topics.decode_json_records(order_records(spark, sf_dir), schemas.RAW_EVENT)
    return bad.select("key")


@query("raw_defaults", """select cast(o_orderkey as varchar) as asset_id, 0.0::double as price, 0.0::double as size, '' as side
  from orders where o_orderstatus = 'O'""")
def raw_defaults(spark, sf_dir):
    good, _ = topics.decode_json_records(order_records(spark, sf_dir), schemas.RAW_EVENT)
    return topics.with_raw_defaults(good).select("asset_id", "price", "size", "side")


RECORD_SQL = """select cast(o_orderkey as varchar) as key,
  '{"v":1,"asset_id":"' || o_orderkey || '"' || case when o_orderstatus = 'F' then '' else ',"side":"' || o_orderstatus || '"' end
  || ',"src_ts":' || o_custkey || '}' as value from orders"""


def typed_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.lit(1).alias("v"), F.col("o_orderkey").cast("string").alias("asset_id"),
        F.when(F.col("o_orderstatus") == "F", F.lit("")).otherwise(F.col("o_orderstatus")).alias("side"),
        F.lit(0.0).alias("price"), F.col("o_custkey").alias("src_ts"))


@query("to_records", RECORD_SQL)
def to_records(spark, sf_dir):
    return topics.to_records(typed_orders(spark, sf_dir), "asset_id", omit_zero=topics.RAW_OPTIONAL)


@query("write_and_read_topic", RECORD_SQL.replace("cast(o_orderkey as varchar) as key,", ""))
def write_and_read_topic(spark, sf_dir):
    folder = scratch(spark, "topic")
    topics.write_topic(typed_orders(spark, sf_dir), folder, "asset_id", omit_zero=topics.RAW_OPTIONAL)
    return topics.read_topic_bounded(spark, folder).select("value")


# --- scalar functions ----------------------------------------------------
@query("pct", "select l_orderkey, l_linenumber, l_partkey, printf('%.1f%%', l_discount * 100) as shown from lineitem")
def pct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.pct("l_discount").alias("shown"))


@query("pp", """select l_orderkey, l_linenumber, l_partkey, case when l_quantity > 25 then '+' else '' end
  || printf('%.1fpp', l_quantity - 25) as shown from lineitem""")
def pp(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.pp(F.col("l_quantity") - 25).alias("shown"))


@query("truncate", """select doc_id, case when length(text) > 60 then substr(text, 1, 59) || '…' else text end as shown from documents""")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate("text", 60).alias("shown"))


@query("surge_line", """select l_orderkey, l_linenumber, l_partkey, l_returnflag || ': ' || printf('%.1f%%', l_tax * 100) || ' → '
  || printf('%.1f%%', l_discount * 100) || ' in 60s' as shown from lineitem""")
def surge_line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        text.surge_line("l_returnflag", "l_tax", "l_discount", F.lit(60)).alias("shown"))


@query("intensity", "select l_orderkey, l_linenumber, l_partkey, round(least(1, abs(l_quantity - 25) / 10), 6)::double as heat from lineitem")
def intensity(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(numbers.intensity(F.col("l_quantity") - 25), "heat"))


@query("clamp", "select o_orderkey, round(greatest(50000, least(o_totalprice, 300000)), 6)::double as price from orders")
def clamp(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(numbers.clamp("o_totalprice", 50_000.0, 300_000.0), "price"))


@query("log_deviation", """select l_suppkey, round(stddev_samp(ln(l_extendedprice)), 6) as sd, round(sqrt(abs(avg(l_tax - l_discount))), 6) as m
  from lineitem group by 1""")
def log_deviation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        r6(F.stddev_samp(F.ln("l_extendedprice")), "sd"), r6(F.sqrt(F.abs(F.avg(F.col("l_tax") - F.col("l_discount")))), "m"))


@query("mid_price", "select l_orderkey, l_linenumber, l_partkey, round((l_tax + l_discount) / 2, 6) as mid from lineitem")
def mid_price(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(numbers.mid_price("l_tax", "l_discount"), "mid"))


@query("time_functions", """select event_id, epoch_us(ts) // 1000 as ms, (epoch_us(ts) // 1000) // 1000 as second,
  strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H') as hour,
  strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as iso,
  cast(floor((epoch_us(ts) // 1000) / 1000 + 0.5) as bigint) as rounded from events""")
def time_functions(spark, sf_dir):
    date, hour = numbers.hour_of("ms")
    return table(spark, sf_dir, "events").select("event_id", ms("ts").alias("ms")).select(
        "event_id", "ms", F.floor(F.col("ms") / 1000).alias("second"), date.alias("date"), hour.alias("hour"),
        numbers.iso_millis("ms").alias("iso"), numbers.whole_seconds("ms").alias("rounded"))


@query("array_functions", f"""with {LINES} select k as market_id, count(*) as n, min(n)::bigint as lo, max(n)::bigint as hi,
  string_agg(n, '|' order by n) filter (where idx < 2) as head from li group by 1""")
def array_functions(spark, sf_dir):
    """Size, extremes and leading slice of each order's flattened line list."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.flatten(F.collect_list(F.array("l_linenumber"))).alias("_n"))
    rows = rows.withColumn("_n", F.array_sort(F.array_distinct("_n")))
    return rows.select(
        F.col("l_orderkey").alias("market_id"), F.size("_n").cast("bigint").alias("n"),
        F.array_min("_n").cast("bigint").alias("lo"), F.array_max("_n").cast("bigint").alias("hi"),
        F.array_join(F.slice("_n", 1, 2), "|").alias("head"))


@query("json_functions", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, event_type || ':' || json_extract_string(props, '$.k') as d from events")
def json_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("_p", F.from_json("props", "k bigint"))
    pair = F.to_json(F.struct("event_type", F.array("_p.k").alias("ks")))
    back = F.from_json(pair, "event_type string, ks array<string>")
    return rows.select("event_id", F.col("_p.k").alias("k"), F.concat(back["event_type"], F.lit(":"), back["ks"][0]).alias("d"))


@query("envelope", """select l_orderkey, '{"t":"ticks","d":[' || string_agg('{"n":' || l_linenumber || '}', ',' order by l_linenumber) || ']}' as frame,
  '{"t":"alert","d":{"o":' || l_orderkey || '}}' as single from lineitem group by 1""")
def envelope(spark, sf_dir):
    item = F.concat(F.lit('{"n":'), F.col("l_linenumber").cast("string"), F.lit("}"))
    one = F.concat(F.lit('{"o":'), F.col("l_orderkey").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("_i")).select(
        "l_orderkey", wire.envelope("ticks", "_i").alias("frame"), wire.envelope_one("alert", one).alias("single"))


@query("server_messages", """select c_custkey, '{"t":"hello","server":"' || c_mktsegment || '","proto":1}' as hello,
  '{"t":"err","code":"too_many_subs","msg":"limit ' || c_nationkey || '"}' as err,
  '{"t":"pong"' || case when c_nationkey = 0 then '' else ',"t0":' || c_nationkey end
    || case when c_custkey = 0 then '' else ',"srv":' || c_custkey end || '}' as pong,
  '{"t":"sys","d":{"clients":' || c_custkey || '}}' as sys from customer""")
def server_messages(spark, sf_dir):
    limit = F.concat(F.lit("limit "), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", wire.hello(F.col("c_mktsegment")).alias("hello"),
        wire.error("too_many_subs", limit).alias("err"),
        wire.pong("c_nationkey", "c_custkey").alias("pong"),
        wire.sys_message(F.struct(F.col("c_custkey").alias("clients"))).alias("sys"))


@query("client_messages", """select o_orderkey, case when o_orderpriority like '1%' then 'ping' else 'sub' end as op,
  case when o_orderpriority like '1%' then null else 'asset' end as ch,
  cast(case when o_orderpriority like '1%' then 0 else 2 end as bigint) as n,
  case when o_orderpriority like '1%' then o_custkey else 0 end as t
from orders where substr(o_orderpriority, 1, 1) in ('1', '2', '3')""")
def client_messages(spark, sf_dir):
    """Pings, subscriptions, unknown operations and broken text, by priority."""
    first, cust = F.substring("o_orderpriority", 1, 1), F.col("o_custkey").cast("string")
    message = (
        F.when(first == "1", F.concat(F.lit('{"op":"ping","t":'), cust, F.lit("}")))
        .when(first.isin("2", "3"), F.concat(F.lit('{"op":"sub","ch":"asset","ids":["'), cust, F.lit('","x"]}')))
        .when(first == "4", F.lit('{"op":"dance"}')).otherwise(F.lit('{"op":'))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", message.alias("text"))
    return wire.client_messages(rows).select("o_orderkey", "op", "ch", F.size("ids").cast("bigint").alias("n"), "t")


@query("unwrap_top", """select o_orderkey, '[{"a":"' || o_orderpriority || '","c5m":1.5}]' as d from orders""")
def unwrap_top(spark, sf_dir):
    record = F.concat(F.lit('{"v":1,"ts":5,"d":[{"a":"'), F.col("o_orderpriority"), F.lit('","c5m":1.5}]}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", wire.unwrap_top(record).alias("d"))
