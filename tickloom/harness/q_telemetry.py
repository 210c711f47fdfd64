"""Counts, rates, percentiles, lag and load reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.harness.adapters import DAY, HOUR, ms, raw_events, table
from tickloom.harness.registry import query, r6
from tickloom.operators import telemetry
from tickloom.operators.ranks import narrowed_percentile, nearest_rank_percentile

MS = "epoch_us(ts) // 1000"


def nth(values: str, p: float) -> str:
    """Nearest rank of a sorted list, SQL."""
    return f"{values}[least(cast(floor(len({values}) * {p}) as bigint) + 1, len({values}))]"


@query("count_by_kind", "select event_type, count(*) as n from events group by 1")
def count_by_kind(spark, sf_dir):
    return telemetry.count_by_kind(table(spark, sf_dir, "events"), "event_type")


def counted(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return {
        "ticks": (events.filter("event_type <> 'error'"), "props"),
        "alerts": (events.filter("event_type = 'error'"), "props"),
        "markets": (table(spark, sf_dir, "part"), None),
    }


@query("stream_counters", """select 'ticks' as topic, count(*) as records, cast(sum(strlen(props)) as bigint) as bytes from events where event_type <> 'error'
union all select 'alerts', count(*), cast(sum(strlen(props)) as bigint) from events where event_type = 'error'
union all select 'markets', count(*), 0 from part""")
def stream_counters(spark, sf_dir):
    return telemetry.pipeline_counters(counted(spark, sf_dir))


@query("nearest_rank_percentile", f"""with s as (select l_returnflag, list(l_extendedprice order by l_extendedprice) as v from lineitem group by 1)
select l_returnflag, cast(p as double) as p, len(v)::bigint as n, round(v[least(cast(floor(len(v) * p) as bigint) + 1, len(v))], 6) as value
from s, (values (0.0::double), (0.5), (0.99), (1.0)) t(p)""")
def percentiles(spark, sf_dir):
    rows = nearest_rank_percentile(table(spark, sf_dir, "lineitem"), "l_extendedprice", (0.0, 0.5, 0.99, 1.0), ("l_returnflag",))
    return rows.select("l_returnflag", "p", F.col("n").cast("bigint").alias("n"), r6("value"))


@query("nearest_rank_percentile_all", f"""with s as (select list(l_quantity order by l_quantity) as v from lineitem)
select {nth("v", 0.5)} as p50, {nth("v", 0.99)} as p99 from s""")
def percentiles_all(spark, sf_dir):
    rows = nearest_rank_percentile(table(spark, sf_dir, "lineitem"), "l_quantity", (0.5, 0.99))
    return rows.agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"),
                    F.max(F.when(F.col("p") == 0.99, F.col("value"))).alias("p99"))


@query("percentile_by_narrowing", """with s as (select list(l_extendedprice order by l_extendedprice) as v from lineitem)
select cast(p as double) as p, len(v)::bigint as n, round(v[least(cast(floor(len(v) * p) as bigint) + 1, len(v))], 6) as value
from s, (values (0.0::double), (0.5), (0.99), (1.0)) t(p)""")
def percentile_by_narrowing(spark, sf_dir):
    rows = narrowed_percentile(table(spark, sf_dir, "lineitem"), "l_extendedprice", (0.0, 0.5, 0.99, 1.0))
    return rows.select("p", "n", r6("value"))


@query("recent_latency_p99", f"""with r as (select value from events order by ts desc, event_id desc limit 4096),
s as (select list(value order by value) as v from r) select len(v)::integer as n, round({nth("v", 0.99)}, 6) as value from s""")
def recent_latency_p99(spark, sf_dir):
    rows = telemetry.recent_percentile(table(spark, sf_dir, "events"), "value", ("ts", "event_id"))
    return rows.select("n", r6("value"))


@query("valid_latency", """select l_orderkey, l_linenumber, l_partkey, cast(l_partkey - l_suppkey * 20 as double) as latency_ms from lineitem
where l_suppkey > 0 and l_partkey >= l_suppkey * 20""")
def valid_latency(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_partkey").alias("now"), (F.col("l_suppkey") * 20).alias("rts"))
    return telemetry.valid_latency(rows).select("l_orderkey", "l_linenumber", "l_partkey", "latency_ms")


BOUNDS = ", ".join(f"('{b}', {b})" for b in telemetry.BUCKETS)


@query("latency_histogram", f"""with x as (select l_returnflag, l_quantity / 10 as v from lineitem),
g as (select l_returnflag, count(*) as count, round(sum(v), 2) as sum from x group by 1)
select g.*, b.le, (select count(*) from x where x.l_returnflag = g.l_returnflag and v <= b.bound) as n
from g, (values {BOUNDS}, ('+Inf', 1e300)) b(le, bound)""")
def latency_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 10).alias("v"))
    return telemetry.latency_histogram(rows, "v", ("l_returnflag",)).select(
        "l_returnflag", "count", F.round("sum", 2).alias("sum"), "le", "n")


@query("rate_per_window", f"""select event_type, ({MS} // {DAY}) * {DAY} as start, count(*) as n, round(count(*) * 1000.0::double / {DAY}, 6) as rate
from events group by 1, 2""")
def rate_per_window(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", ms("ts").alias("ms"))
    return telemetry.rate_per_window(rows, "ms", DAY, ("event_type",)).select("event_type", "start", "n", r6("rate"))


@query("counter_rates", f"""with c as (select event_type, {MS} as ms, event_id, lag(event_id) over w as pc, lag({MS}) over w as pt
  from events window w as (partition by event_type order by {MS}))
select event_type, ms, case when ms > pt then round((event_id - pc) / ((ms - pt) / 1000.0::double), 6) end as rate from c""")
def counter_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", ms("ts").alias("ms"), "event_id")
    return telemetry.counter_rates(rows, "event_id", "ms", ("event_type",), 3 * DAY).select("event_type", "ms", r6("rate"))


SYS = f"""i as (select ({MS} // {DAY}) * {DAY} as start, event_id from events),
rk as (select event_id, value, row_number() over (order by ts, event_id) as n from events),
ci as (select start, count(*) * 1000.0::double / {DAY} as in_eps, max(n) as newest from i join rk using (event_id) group by 1),
co as (select ({MS} // {DAY}) * {DAY} as start, count(*) * 1000.0::double / {DAY} as out_mps from events where event_type = 'view' group by 1),
se as (select 1704067200000 + (c_custkey * {HOUR} // 10) as a, 1704067200000 + (c_custkey * {HOUR} // 10) + c_nationkey * {DAY} as b from customer)"""


@query("sys_stats", f"""with {SYS}
select start, (select count(*) from se where (a // {DAY}) * {DAY} <= start) - (select count(*) from se where (b // {DAY}) * {DAY} <= start) as clients,
  round(in_eps, 6) as in_eps, round(coalesce(out_mps, 0), 6) as out_mps,
  round((select {nth("list(value order by value)", 0.99)} from rk where rk.n <= ci.newest and rk.n > ci.newest - 700), 6) as p99_ms
from ci left join co using (start)""")
def sys_stats(spark, sf_dir):
    """Days play seconds; each customer is connected for some days. A day has more
    events than the 700 newest the percentile covers at some scales, fewer at others."""
    events = table(spark, sf_dir, "events").select(
        ms("ts").alias("ts"), F.col("value").alias("latency_ms"), "event_type", "event_id")
    opened = F.lit(1_704_067_200_000) + F.call_function("div", F.col("c_custkey") * HOUR, F.lit(10))
    sessions = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), opened.alias("start"),
        (opened + F.col("c_nationkey").cast("bigint") * DAY).alias("end"))
    rows = telemetry.sys_stats(events, events.filter("event_type = 'view'"), sessions, window_ms=DAY, last=700,
                               order=("ts", "event_id"))
    return rows.select("start", F.col("clients").cast("bigint").alias("clients"), r6("in_eps"), r6("out_mps"), r6("p99_ms"))


@query("client_report", f"""with c as (select o_orderkey, o_orderstatus <> 'F' as up, o_orderpriority like '1%' and o_orderstatus <> 'F' as slow, o_custkey as msgs from orders),
l as (select list(l_extendedprice order by l_extendedprice) as v from lineitem join c on l_orderkey = o_orderkey where not slow)
select count(*) as attempted, count(*) filter (where up) as established,
  round(count(*) filter (where up) * 100.0::double / count(*), 6) as established_pct, count(*) filter (where not up) as failed,
  count(*) filter (where slow) as slow, count(*) filter (where up) - count(*) filter (where slow) as normal,
  cast(sum(msgs) filter (where not slow) as bigint) as messages, max(len(v))::bigint as samples,
  round(sum(msgs) filter (where not slow) / 60.0::double, 6) as msgs_per_s,
  round(max({nth("v", 0.5)}), 6) as p50_ms, round(max({nth("v", 0.99)}), 6) as p99_ms from c, l""")
def client_report(spark, sf_dir):
    up = F.col("o_orderstatus") != "F"
    connections = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("client_id"), up.alias("connected"),
        (F.col("o_orderpriority").startswith("1") & up).alias("slow"), F.col("o_custkey").alias("msgs"))
    latencies = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("client_id"), F.col("l_extendedprice").alias("latency_ms"))
    rows = telemetry.client_report(connections, latencies, 60)
    return rows.select("attempted", "established", r6("established_pct"), "failed", "slow", "normal", "messages",
                       F.col("samples").cast("bigint").alias("samples"), r6("msgs_per_s"), r6("p50_ms"), r6("p99_ms"))


# Orders play polls, suppliers partitions: one sample per order and supplier.
@query("partition_lag", """with p as (select l_orderkey as poll, l_suppkey as part, max(l_partkey) + 50 as hwm, min(l_partkey) as off from lineitem group by 1, 2),
d as (select poll, hwm - (off + 1) - coalesce(lag(hwm - (off + 1)) over (partition by part order by poll), 0) as d from p),
s as (select poll, sum(d) as d from d group by 1)
select poll, cast(sum(d) over (order by poll) as bigint) as lag from s""")
def partition_lag(spark, sf_dir):
    polls = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("poll"), F.col("l_suppkey").alias("partition")
    ).agg((F.max("l_partkey") + 50).alias("hwm"), F.min("l_partkey").alias("last_offset"))
    return telemetry.partition_lag(polls, 1_000)
