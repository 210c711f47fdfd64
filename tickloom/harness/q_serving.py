"""Joins, subscriptions, fan-out, lists and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.harness.adapters import (
    DAY, HOUR, customer_markets, customer_subs, line_ticks, messages, ms, order_markets, order_ops, recording,
    table, user_ops, user_ticks,
)
from tickloom.harness.q_frames import LINES
from tickloom.harness.q_series import MARKETS, USER_TICKS
from tickloom.harness.registry import query, r6
from tickloom.operators import catalog, joins, ranks, serving
from tickloom.operators.axis import Axis, running

MS = "epoch_us(ts) // 1000"


def event_alerts(spark, sf_dir):
    """Every event as an alert of its user's market."""
    market = F.concat(F.lit("m"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset_id"), F.when(F.col("value") < 5, F.lit("none")).otherwise(market).alias("market_id"),
        ms("ts").alias("recv_ts"), F.col("event_id").alias("ord"))


ALERTS = f"""al as (select event_type as asset_id, case when value < 5 then 'none' else 'm' || user_id end as market_id,
  {MS} as recv_ts, event_id as ord from events)"""


@query("enrich_alerts", f"""with {ALERTS}, {MARKETS}
select a.ord, a.market_id, coalesce(k.question, '') as question,
  coalesce(k.outcomes[list_position(k.clob_token_ids, a.asset_id)], '') as outcome
from al a left join mk k on a.market_id = k.market_id""")
def enrich_alerts(spark, sf_dir):
    rows = joins.enrich_alerts(event_alerts(spark, sf_dir), customer_markets(spark, sf_dir))
    return rows.select("ord", "market_id", "question", "outcome")


VERSIONS = f"""vs as (select 'm' || user_id as market_id, 'q' || event_id as question, event_type,
  {MS} as known_at, event_id as v from events where event_type in ('click', 'view'))"""


def versions(spark, sf_dir):
    """A change log of markets: clicks and views are new versions of the user's market."""
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view")).select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("market_id"),
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("question"),
        F.array(F.lit("Yes")).alias("outcomes"), F.array("event_type").alias("clob_token_ids"),
        ms("ts").alias("known_at"), F.col("event_id").alias("v"))


@query("enrich_alerts_latest", f"""with {ALERTS}, {VERSIONS},
l as (select * from vs qualify row_number() over (partition by market_id order by known_at desc, v desc) = 1)
select a.ord, coalesce(l.question, '') as question, case when l.event_type = a.asset_id then 'Yes' else '' end as outcome
from al a left join l on a.market_id = l.market_id""")
def enrich_alerts_latest(spark, sf_dir):
    rows = joins.enrich_alerts(event_alerts(spark, sf_dir), versions(spark, sf_dir), order=("known_at", "v"))
    return rows.select("ord", "question", "outcome")


@query("enrich_alerts_as_of", f"""with {ALERTS}, {VERSIONS}
select a.ord, coalesce(l.question, '') as question, case when l.event_type = a.asset_id then 'Yes' else '' end as outcome
from al a asof left join vs l on a.market_id = l.market_id and l.known_at <= a.recv_ts""")
def enrich_alerts_as_of(spark, sf_dir):
    rows = joins.enrich_alerts(
        event_alerts(spark, sf_dir), versions(spark, sf_dir), order=("known_at", "v"), as_of=True)
    return rows.select("ord", "question", "outcome")


@query("asof_join", """with o as (select o_orderkey, substr(o_orderpriority, 3) as k, epoch_us(o_orderdate) // 1000 + o_custkey as t from orders),
l as (select l_orderkey, l_linenumber, l_partkey, substr(o_orderpriority, 3) as k, epoch_us(l_shipdate) // 1000 + l_suppkey as t
      from lineitem join orders on l_orderkey = o_orderkey),
r as (select k, t, max(o_orderkey) as o_orderkey from o group by 1, 2)
select l.l_orderkey, l.l_linenumber, l.l_partkey, r.o_orderkey as hit, r.t as hit_t
from l asof left join r on l.k = r.k and r.t <= l.t""")
def asof_join(spark, sf_dir):
    """Newest order of the same priority placed before each shipment."""
    orders, kind = table(spark, sf_dir, "orders"), F.expr("substring(o_orderpriority, 3)").alias("k")
    right = orders.select(kind, "o_orderkey", (ms("o_orderdate") + F.col("o_custkey")).alias("t"))
    left = table(spark, sf_dir, "lineitem").join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), kind), "l_orderkey"
    ).select("k", "l_orderkey", "l_linenumber", "l_partkey", (ms("l_shipdate") + F.col("l_suppkey")).alias("lt"))
    rows = joins.asof_join(left, right, ("k",), "lt", "t", right_order=("o_orderkey",), width=90 * DAY)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("hit.o_orderkey").alias("hit"), F.col("hit.t").alias("hit_t"))


LATEST_LINE = """lt as (select 'a' || l_orderkey || '-' || l_linenumber as a, l_extendedprice as p, l_tax as b, l_discount as k,
    l_discount as c1m, l_quantity - 25 as c5m, l_tax as vol from lineitem
  qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc) = 1)"""

FIRST_ASSET = f"""{LINES}, fm as (select k as market_id, o_orderpriority as question, o_totalprice as volume,
    'a' || k || '-' || n as asset_id from li join orders on k = o_orderkey where idx = 0)"""


@query("latest_tick_view", f"""with {FIRST_ASSET}, {LATEST_LINE}
select market_id, question, round(volume, 6) as volume, asset_id, p is not null as has_tick,
  round(coalesce(p, 0), 6) as p, round(coalesce(c5m, 0), 6) as c5m from fm left join lt on asset_id = a""")
def latest_tick_view(spark, sf_dir):
    rows = joins.latest_tick_view(order_markets(spark, sf_dir), line_ticks(spark, sf_dir))
    return rows.select("market_id", "question", r6("volume"), "asset_id", "has_tick", r6("p"), r6("c5m"))


@query("market_detail", f"""with {LINES}, {LATEST_LINE}
select li.k as market_id, idx, 'a' || li.k || '-' || n as asset_id,
  case when o_orderstatus = 'P' and idx > 0 then 'Outcome ' || (idx + 1) else 'L' || n end as outcome,
  round(p, 6) as p, round(b, 6) as b, round(lt.k, 6) as ask, round(c1m, 6) as c1m, round(c5m, 6) as c5m, round(vol, 6) as vol
from li join orders on li.k = o_orderkey left join lt on a = 'a' || li.k || '-' || n""")
def market_detail(spark, sf_dir):
    rows = joins.market_detail(order_markets(spark, sf_dir), line_ticks(spark, sf_dir))
    return rows.select("market_id", F.col("idx").cast("bigint").alias("idx"), "asset_id", "outcome", r6("p"), r6("b"),
                       r6("k", "ask"), r6("c1m"), r6("c5m"), r6("vol"))


@query("alerts_question", """with mk as (
  select c_name, unnest(case when c_nationkey < 12 then ['click', 'view'] else ['error', 'signup'] end) as a from customer),
l as (select a, max(c_name) as q from mk group by 1)
select event_id, event_type as a, coalesce(l.q, 'own') as q from events left join l on event_type = l.a""")
def alerts_question(spark, sf_dir):
    """Purchases are in no market here, so their own question stays."""
    markets = customer_markets(spark, sf_dir).withColumn("clob_token_ids", F.array_remove("clob_token_ids", "purchase"))
    alerts = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("a"), F.lit("own").alias("q"))
    return joins.alerts_question(alerts, markets, ("question",)).select("event_id", "a", "q")


# --- lists ---------------------------------------------------------------
@query("top_n_markets", f"with {MARKETS} select market_id, round(volume, 6) as volume from mk order by mk.volume desc, market_id limit 100")
def top_n_markets(spark, sf_dir):
    return catalog.top_n_markets(customer_markets(spark, sf_dir), 100).select("market_id", r6("volume"))


@query("market_wall", f"""with {FIRST_ASSET}, {LATEST_LINE},
t as (select * from fm order by volume desc, market_id limit 100)
select market_id, question as title, round(volume, 6) as volume, asset_id, p is not null as has_tick, round(coalesce(p, 0), 6) as p,
  round(coalesce(c5m, 0), 6) as c5m, round(least(1, abs(coalesce(c5m, 0)) / 10), 6)::double as heat from t left join lt on asset_id = a""")
def market_wall(spark, sf_dir):
    rows = catalog.market_wall(order_markets(spark, sf_dir), line_ticks(spark, sf_dir))
    return rows.select("market_id", "title", r6("volume"), "asset_id", "has_tick", r6("p"), r6("c5m"), r6("heat"))


@query("recent_alerts", f"""select event_id, user_id, {MS} as ts from events where event_type = 'error'
order by events.ts desc, event_id desc limit 50""")
def recent_alerts(spark, sf_dir):
    alerts = table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select("event_id", "user_id", ms("ts").alias("ts"))
    return catalog.recent_alerts(alerts, 50, ("ts", "event_id"))


@query("resort_top", """select l_orderkey, string_agg(l_partkey, '|' order by abs(l_quantity - 25) desc, cast(l_partkey as varchar), l_quantity) as ranked
from lineitem group by 1""")
def resort_top(spark, sf_dir):
    entry = F.struct(F.col("l_partkey").cast("string").alias("a"), (F.col("l_quantity") - 25).alias("c5m"))
    top = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(entry).alias("d"))
    return catalog.resort_top(top).select("l_orderkey", F.array_join(F.col("d.a"), "|").alias("ranked"))


@query("assign_chunks", """select p_partkey, cast((row_number() over (order by p_name, p_partkey) - 1) // 200 as bigint) as chunk from (
  select p_partkey, cast(p_partkey as varchar) as p_name from part)""")
def assign_chunks(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("asset_id"))
    return ranks.assign_chunks(ids, 200).select(F.col("asset_id").cast("bigint").alias("p_partkey"), "chunk")


@query("tail_n", """select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 500""")
def tail_n(spark, sf_dir):
    return ranks.tail_n(table(spark, sf_dir, "orders"), 500, ("o_orderdate", "o_orderkey")).select("o_orderkey")


@query("diff_assets", """with a as (select distinct l_partkey as id from lineitem where l_shipdate < timestamp '1998-01-01'),
b as (select distinct l_partkey as id from lineitem where l_shipdate >= timestamp '1998-01-01' and l_returnflag = 'R')
select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' else 'kept' end as status
from a full join b on a.id = b.id""")
def diff_assets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_partkey"))
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    old = lines.filter(F.col("l_shipdate") < split)
    new = lines.filter((F.col("l_shipdate") >= split) & (F.col("l_returnflag") == "R"))
    return catalog.diff_assets(old, new, "id")


@query("union_streams", f"""select case when event_type = 'error' then 'alert' else 'tick' end as t, cast(event_id as varchar) as d from events
union all select 'alert', event_type from events""")
def union_streams(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ids = F.col("event_id").cast("string").alias("value")
    is_error = F.col("event_type") == "error"
    alerts = events.filter(is_error).select(ids).unionByName(events.select(F.col("event_type").alias("value")))
    return catalog.union_streams(events.filter(~is_error).select(ids), alerts)


@query("retain", f"select event_id from events where {MS} > (select max({MS}) from events) - {7 * DAY}")
def retain(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", ms("ts").alias("ms"))
    newest = rows.agg(F.max("ms")).first()[0]
    return catalog.retain(rows, "ms", newest, 7 * DAY).select("event_id")


@query("trailing_duration", f"select event_id from events where {MS} >= (select max({MS}) from events) - {3 * DAY}")
def trailing_duration(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", ms("ts").alias("ms"))
    return catalog.trailing_duration(rows, "ms", 3 * DAY).select("event_id")


@query("only_kind", "select event_id from events where event_type = 'error'")
def only_kind(spark, sf_dir):
    return catalog.only_kind(table(spark, sf_dir, "events"), "error", "event_type").select("event_id")


# --- subscriptions -------------------------------------------------------
# Each key's own timeline: its requests and all closes of its client.
INTERVALS = """ops as (
  select o_custkey as client_id, epoch_us(o_orderdate) // 1000 as ts, o_orderkey as ord,
    case o_orderstatus when 'O' then 'sub' when 'F' then 'unsub' else 'close' end as op,
    case when o_totalprice < 400000 then 'asset' else 'top' end as ch,
    case when o_totalprice < 200000 then [o_orderpriority] else [o_orderpriority, '1-URGENT'] end as ids from orders),
req as (select distinct client_id, ts, ord, op, ch, unnest(case when ch = 'asset' then ids else [''] end) as id
  from ops where op <> 'close'),
line as (
  select * from req union all
  select o.client_id, o.ts, o.ord, o.op, k.ch, k.id from ops o
  join (select distinct client_id, ch, id from req) k on o.client_id = k.client_id where o.op = 'close'),
steps as (
  select *, lag(op) over (partition by client_id, ch, id order by ts, ord) as prev from line),
eff as (
  select client_id, ch, id, ts, ord, case when op = 'sub' then 1 else -1 end as step from steps
  where (op = 'sub' and coalesce(prev, 'close') <> 'sub') or (op <> 'sub' and prev = 'sub')),
iv as (
  select client_id, ch, id, ts as start, ord as start_ord,
    lead(ts) over w as e, lead(ord) over w as eo, step from eff
  window w as (partition by client_id, ch, id order by ts, ord)),
intervals as (
  select client_id, ch, id, start, start_ord, coalesce(e, 4611686018427387904) as "end",
    coalesce(eo, 4611686018427387904) as end_ord from iv where step = 1)"""
YEAR = 365 * DAY
# The same for users' ticks, dealt over January.
USER_INTERVALS = f"""ops as (
  select o_custkey as client_id, 1704067200000 + o_orderkey * 104729 % {30 * DAY} as ts, o_orderkey as ord,
    case o_orderstatus when 'O' then 'sub' when 'F' then 'unsub' else 'close' end as op, 'asset' as ch,
    ['u' || (o_custkey // 10), 'u' || (o_orderkey % 1000)] as ids from orders),
req as ({INTERVALS.partition("req as (")[2]}"""


@query("subscription_intervals", f"with {INTERVALS} select * from intervals")
def subscription_intervals(spark, sf_dir):
    return serving.subscription_intervals(order_ops(spark, sf_dir), YEAR)


@query("apply_subscription_ops", f"with {INTERVALS} select client_id, ch, id, ts, ord, step::integer as step from eff")
def apply_subscription_ops(spark, sf_dir):
    rows = serving.apply_subscription_ops(order_ops(spark, sf_dir), 0, YEAR)
    return rows.select("client_id", "ch", "id", "ts", "ord", "step")


# A cap no client can reach must give the uncapped result, through the fold.
@query("apply_subscription_ops_folded", f"with {INTERVALS} select client_id, ch, id, ts, ord, step::integer as step from eff")
def apply_subscription_ops_folded(spark, sf_dir):
    rows = serving.apply_subscription_ops(order_ops(spark, sf_dir), 1_000_000, YEAR)
    return rows.select("client_id", "ch", "id", "ts", "ord", "step")


# The log as a fold over each client's operations, holding the list of its keys.
CAPPED = f"""{INTERVALS.split("req as (")[0]}
asked as (select *, row_number() over (partition by client_id order by ts, ord) as rn,
  list_transform(case when ch = 'asset' then ids else [''] end, lambda i: ch || '|' || i) as ks from ops),
fold as (
  select client_id, 0::bigint as rn, null::bigint as ts, null::bigint as ord, null::varchar as op, null::varchar as ch, []::varchar[] as ks,
    []::varchar[] as was, []::varchar[] as held, false as refused from (select distinct client_id from ops)
  union all
  select a.client_id, a.rn, a.ts, a.ord, a.op, a.ch, a.ks, f.held,
    case when a.op = 'close' then [] when a.op = 'unsub' then list_filter(f.held, lambda k: not list_contains(a.ks, k))
      when len(f.held) + len(list_filter(a.ks, lambda k: not list_contains(f.held, k))) > 2 then f.held
      else list_distinct(list_concat(f.held, a.ks)) end,
    a.op = 'sub' and len(f.held) + len(list_filter(a.ks, lambda k: not list_contains(f.held, k))) > 2
  from fold f join asked a on a.client_id = f.client_id and a.rn = f.rn + 1),
capped as (
  select client_id, split_part(k, '|', 1) as ch, split_part(k, '|', 2) as id, ts, ord, 1 as step, null::varchar as error
  from (select *, unnest(list_filter(held, lambda k: not list_contains(was, k))) as k from fold) union all
  select client_id, split_part(k, '|', 1), split_part(k, '|', 2), ts, ord, -1, null
  from (select *, unnest(list_filter(was, lambda k: not list_contains(held, k))) as k from fold) union all
  select client_id, ch, null, ts, ord, 0, 'too_many_subs' from fold where refused)"""


@query("apply_subscription_ops_capped", f"with recursive {CAPPED} select * from capped")
def apply_subscription_ops_capped(spark, sf_dir):
    return serving.apply_subscription_ops(order_ops(spark, sf_dir), 2, YEAR)


@query("subscription_rejections", f"""with recursive {CAPPED} select client_id, ts, ord,
  '{{"t":"err","code":"too_many_subs","msg":"limit 2"}}' as frame from capped where error is not null""")
def subscription_rejections(spark, sf_dir):
    return serving.rejections(serving.apply_subscription_ops(order_ops(spark, sf_dir), 2, YEAR), 2)


@query("subscription_counts", f"""with {INTERVALS},
per as (select client_id, ts, sum(step) as d from eff group by 1, 2),
cum as (select *, sum(d) over (partition by client_id order by ts) as live from per),
tot as (select ts, sum(d) as d, sum(case when live - d = 0 and live > 0 then 1 when live - d > 0 and live = 0 then -1 else 0 end) as c
  from cum group by 1)
select ts, cast(sum(d) over (order by ts) as bigint) as subscriptions, cast(sum(c) over (order by ts) as bigint) as clients from tot""")
def subscription_counts(spark, sf_dir):
    steps = serving.apply_subscription_ops(order_ops(spark, sf_dir), 0, YEAR)
    return serving.subscription_counts(steps, YEAR)


AT = 883_612_800_000  # 1998-01-01


@query("live_counts_by_key", f"""with {INTERVALS} select ch, id, count(*) as n from intervals
where start <= {AT} and "end" > {AT} group by 1, 2""")
def live_counts_by_key(spark, sf_dir):
    return serving.live_counts_at(serving.subscription_intervals(order_ops(spark, sf_dir), YEAR), AT, ("ch", "id"))


@query("live_counts_by_client", f"""with {INTERVALS} select client_id, count(*) as n from intervals
where start <= {AT} and "end" > {AT} group by 1""")
def live_counts_by_client(spark, sf_dir):
    return serving.live_counts_at(serving.subscription_intervals(order_ops(spark, sf_dir), YEAR), AT, ("client_id",))


SUBS = f"""sb as (select c_custkey as client_id, 'u' || (c_custkey // 10) as id,
    1704067200000 + cast(floor(abs(c_acctbal) * 100) as bigint) * 1000 as start,
    1704067200000 + cast(floor(abs(c_acctbal) * 100) as bigint) * 1000 + c_nationkey * {DAY} + {HOUR} as "end" from customer),
ms as (select 'u' || user_id as id, {MS} as ts, event_id as ord,
    '{{"a":"u' || user_id || '","seq":' || event_id || '}}' as value from events),
dl as (select client_id, ms.* from ms join sb on ms.id = sb.id and ts >= start and ts < "end")"""


@query("subscribed_only", f"""with {SUBS} select ord from ms
where exists (select 1 from sb where sb.id = ms.id and ts >= start and ts < "end")""")
def subscribed_only(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumnRenamed("id", "a")
    return serving.subscribed_only(rows, customer_subs(spark, sf_dir), width=DAY).select("ord")


@query("fanout_join", f"with {SUBS} select client_id, ord, ts, value from dl")
def fanout_join(spark, sf_dir):
    return serving.fanout_join(messages(spark, sf_dir), customer_subs(spark, sf_dir)).select("client_id", "ord", "ts", "value")


USER_FANOUT = f"""with {USER_INTERVALS},
ms as (select 'u' || user_id as id, {MS} as ts, event_id as ord,
    '{{"a":"u' || user_id || '","seq":' || event_id || '}}' as value from events)
select client_id, ms.id, ms.ts, ms.ord, value from ms join intervals i on ms.id = i.id
  and (start < ms.ts or (start = ms.ts and start_ord <= ms.ord)) and ("end" > ms.ts or ("end" = ms.ts and end_ord > ms.ord))"""


@query("fanout_join_changing", USER_FANOUT)
def fanout_join_changing(spark, sf_dir):
    """Clients that subscribe and leave again; intervals and messages meet in time buckets."""
    intervals = serving.subscription_intervals(user_ops(spark, sf_dir), 7 * DAY)
    rows = serving.fanout_join(messages(spark, sf_dir), intervals, bucket_ms=HOUR)
    return rows.select("client_id", "id", "ts", "ord", "value")


@query("fanout_join_hot", f"with {SUBS} select client_id, ord, ts, value from dl")
def fanout_join_hot(spark, sf_dir):
    """The same deliveries with every busy user spread over several tasks."""
    feed = messages(spark, sf_dir)
    hot = joins.hot_keys(feed, ("ch", "id"), 50)
    rows = serving.fanout_join(feed, customer_subs(spark, sf_dir), hot=hot)
    return rows.select("client_id", "ord", "ts", "value")


CONFLATED = f"""with {SUBS},
l as (select client_id, (ts // {6 * HOUR}) * {6 * HOUR} as flush, id, arg_max(value, ts) as value from dl group by 1, 2, 3)
select client_id, flush, 'ticks' as t, count(*) as n,
  '{{"t":"ticks","d":[' || string_agg(value, ',' order by id) || ']}}' as frame from l group by 1, 2"""


@query("conflate", CONFLATED)
def conflate(spark, sf_dir):
    deliveries = serving.fanout_join(messages(spark, sf_dir), customer_subs(spark, sf_dir))
    return serving.conflate(deliveries, 6 * HOUR).withColumn("n", F.col("n").cast("bigint"))


@query("conflate_before_fanout", CONFLATED)
def conflate_before_fanout(spark, sf_dir):
    """The same messages, reducing the feed before it is multiplied."""
    deliveries = serving.conflate_before_fanout(messages(spark, sf_dir), customer_subs(spark, sf_dir), 6 * HOUR)
    return serving.conflate(deliveries, 6 * HOUR).withColumn("n", F.col("n").cast("bigint"))


@query("conflate_channels", f"""with e as (select user_id as client_id, event_id as ord, {MS} as ts, event_type,
    '{{"e":' || event_id || '}}' as value, ({MS} // {DAY}) * {DAY} as flush from events)
select client_id, flush, 'top' as t, 1 as n, '{{"t":"top","d":' || arg_max(value, ts) || '}}' as frame from e where event_type = 'view' group by 1, 2
union all select client_id, flush, case event_type when 'error' then 'alert' else 'sys' end, 1,
  '{{"t":"' || case event_type when 'error' then 'alert' else 'sys' end || '","d":' || value || '}}' from e where event_type in ('error', 'signup')""")
def conflate_channels(spark, sf_dir):
    """Top lists are conflated; alerts and sys messages are not."""
    kind = F.col("event_type")
    ch = F.when(kind == "view", "top").when(kind == "error", "alerts").when(kind == "signup", "sys")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("client_id"), ch.alias("ch"), F.lit("").alias("id"), ms("ts").alias("ts"),
        F.col("event_id").alias("ord"),
        F.concat(F.lit('{"e":'), F.col("event_id").cast("string"), F.lit("}")).alias("value")).filter("ch is not null")
    return serving.conflate(rows, DAY).select("client_id", "flush", "t", "n", "frame")


@query("flash_keys", f"with {USER_TICKS} select distinct (pts // {HOUR}) * {HOUR} as batch, a from tk")
def flash_keys(spark, sf_dir):
    return serving.flash_keys(user_ticks(spark, sf_dir), HOUR)


# Customers ask for two users' ticks at a moment in January.
SNAP_OPS = """sn as (select c_custkey as client_id, 1704067200000 + cast(floor(abs(c_acctbal) * 25) as bigint) * 10000 as ts,
    unnest(['u' || (c_custkey // 10), 'u' || c_nationkey, 'nobody']) as id, unnest([0, 1, 2]) as pos from customer)"""


def snapshot_ops(spark, sf_dir):
    """One request per customer, for three ids."""
    start = F.lit(1_704_067_200_000) + F.floor(F.abs("c_acctbal") * 25).cast("bigint") * 10_000
    ids = F.array(
        F.concat(F.lit("u"), F.call_function("div", F.col("c_custkey"), F.lit(10)).cast("string")),
        F.concat(F.lit("u"), F.col("c_nationkey").cast("string")), F.lit("nobody"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), start.alias("ts"), F.lit(1 << 40).alias("ord"),
        F.lit("sub").alias("op"), F.lit("asset").alias("ch"), ids.alias("ids"))


@query("snapshot_on_subscribe", f"""with {SUBS}, {SNAP_OPS},
h as (select sn.client_id, sn.ts, sn.pos, ms.value from sn asof join ms on sn.id = ms.id and ms.ts <= sn.ts)
select client_id, ts, 'snap' as t, count(*) as n, '{{"t":"snap","d":[' || string_agg(value, ',' order by pos) || ']}}' as frame
from h group by 1, 2""")
def snapshot_on_subscribe(spark, sf_dir):
    rows = serving.snapshot_on_subscribe(snapshot_ops(spark, sf_dir), messages(spark, sf_dir), width=DAY)
    return rows.select("client_id", "ts", "t", F.col("n").cast("bigint").alias("n"), "frame")


@query("top_on_subscribe", f"""with {SUBS},
q as (select c_custkey as client_id, 1704067200000 + cast(floor(abs(c_acctbal) * 25) as bigint) * 10000 as ts, 1 as one from customer),
v as (select ts, value, 1 as one from ms)
select client_id, q.ts, 'top' as t, '{{"t":"top","d":' || value || '}}' as frame from q asof join v on q.one = v.one and v.ts <= q.ts""")
def top_on_subscribe(spark, sf_dir):
    start = F.lit(1_704_067_200_000) + F.floor(F.abs("c_acctbal") * 25).cast("bigint") * 10_000
    ops = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), start.alias("ts"), F.lit(1 << 40).alias("ord"), F.lit("sub").alias("op"),
        F.lit("top").alias("ch"), F.array().cast("array<string>").alias("ids"))
    feed = messages(spark, sf_dir)
    return serving.snapshot_on_subscribe(ops, feed, feed, width=DAY).select("client_id", "ts", "t", "frame")


@query("consecutive_full_runs", """with c as (select l_suppkey as client_id, row_number() over (partition by l_suppkey
    order by l_orderkey, l_linenumber, l_partkey) as cycle, l_returnflag = 'R' as f from lineitem),
g as (select *, lag(f, 1) over w as f1, lag(f, 2) over w as f2 from c window w as (partition by client_id order by cycle))
select client_id, min(cycle) as cycle from g where f and f1 and f2 group by 1""")
def consecutive_full_runs(spark, sf_dir):
    """Suppliers play clients, their lines in order play flush cycles."""
    axis = Axis(("client_id",), ("l_orderkey", "l_linenumber", "l_partkey"), 10_000)
    lines = table(spark, sf_dir, "lineitem").withColumn("client_id", F.col("l_suppkey"))
    cycles = running(lines, axis, sums={"cycle": F.lit(1)}).select(
        "client_id", F.col("cycle").cast("bigint").alias("cycle"), (F.col("l_returnflag") == "R").alias("full"))
    return serving.consecutive_full_runs(cycles, 3, 100)


# Windows of one day, at most two messages each; the connect is on 1 January.
@query("rate_limit_violations", f"""with recursive r as (
  select user_id, 1704067200000 as recv_ts, -1 as ord, 0 as m from (select distinct user_id from events)
  union all select user_id, {MS}, event_id, 1 from events),
p as (select *, row_number() over (partition by user_id order by recv_ts, m, ord) as rn from r),
n as materialized (select user_id, rn, min(rn) over (partition by user_id order by recv_ts
    range between {DAY} following and unbounded following) as nrn from p),
w as (select user_id, rn from p where rn = 1 union all
  select n.user_id, n.nrn from w join n on w.user_id = n.user_id and w.rn = n.rn where n.nrn is not null),
k as (select p.*, max(case when w.rn is not null then p.rn end) over (partition by p.user_id order by p.rn) as base
  from p left join w on p.user_id = w.user_id and p.rn = w.rn),
c as (select *, row_number() over (partition by user_id, base order by rn) as i from k where m = 1),
f as (select * from c where i = 4)
select user_id as client_id, recv_ts as ts, ord::bigint as ord from f
qualify row_number() over (partition by user_id order by rn) = 1""")
def rate_limit_violations(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("client_id"), ms("ts").alias("ts"), F.col("event_id").alias("ord"))
    connects = log.select("client_id").distinct().withColumn("ts", F.lit(1_704_067_200_000))
    return serving.rate_limit_violations(connects, log, limit=3, window_ms=DAY, width=3 * DAY)
