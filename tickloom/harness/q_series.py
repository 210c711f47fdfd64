"""Time-series operators over ``events``; assets are event types."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.harness.adapters import (
    DAY, HOUR, P, customer_markets, event_frames, line_ticks, raw_events, scratch, table, user_ticks,
)
from tickloom.harness.registry import ORACLES, query, r6
from tickloom.operators import keyed, series
from tickloom.operators.gap import sample_min_gap
from tickloom.plans import pipeline
from tickloom.schemas import ALERT
from tickloom.sources import frames, topics

JAN_20 = 1_705_708_800_000
JAN_1 = 1_704_067_200_000

EV = """ev as (
  select event_type as asset_id,
         case when user_id < 15 then '' else 'm' || (user_id // 15) end as market_id,
         case when value < 1 then 0.0 else value end as price,
         case when value < 2 then 0.0 else value - 0.5 end as best_bid,
         case when value < 3 then 0.0 else value + 0.5 end as best_ask,
         epoch_us(ts) // 1000 as recv_ts, event_id as ord
  from events)"""


def greedy(name: str, source: str, gap: int, key: str = "asset_id") -> str:
    """Recursive CTEs: rows of ``source`` kept at least ``gap`` apart, as ``name``."""
    return f"""{name}_p as (
  select *, row_number() over (partition by {key} order by recv_ts, ord) as rn from {source}),
{name}_n as materialized (
  select {key}, rn, min(rn) over (partition by {key} order by recv_ts
    range between {gap} following and unbounded following) as nrn from {name}_p),
{name}_w as (
  select {key}, rn from {name}_p where rn = 1
  union all
  select n.{key}, n.nrn from {name}_w w join {name}_n n on w.{key} = n.{key} and w.rn = n.rn
  where n.nrn is not null),
{name} as (
  select p.* exclude (rn), row_number() over (partition by p.{key} order by p.recv_ts, p.ord) as n
  from {name}_p p join {name}_w w on p.{key} = w.{key} and p.rn = w.rn)"""


PRICED = "pr as (select asset_id, recv_ts, ord, price from ev where price <> 0)"

CARRIED = """cf as (
  select asset_id, recv_ts, ord, price,
         last_value(nullif(market_id, '') ignore nulls) over w as market_id,
         last_value(nullif(price, 0) ignore nulls) over w as last,
         last_value(nullif(best_bid, 0) ignore nulls) over w as best_bid,
         last_value(nullif(best_ask, 0) ignore nulls) over w as best_ask
  from ev window w as (partition by asset_id order by recv_ts, ord
                       rows between unbounded preceding and current row))"""

CHANGED = """ch as (
  select asset_id, recv_ts, ord, price,
         row_number() over (partition by asset_id order by recv_ts, ord) as seq
  from (select *, lag(price) over (partition by asset_id order by recv_ts, ord) as prev from pr)
  where prev is null or prev <> price)"""


def asof(name: str, back: int) -> str:
    return (
        f"{name} as (select c.asset_id, c.ord, s.price, s.n from cf c asof join sm s "
        f"on c.asset_id = s.asset_id and s.recv_ts <= c.recv_ts - {back})"
    )


def stats(p=P) -> str:
    """CTEs from ``ev`` to ``st``: the state and statistics at every event."""
    return f"""{EV},
{PRICED},
{greedy("sm", "pr", p.gap_ms)},
{CARRIED},
{CHANGED},
{asof("h0", 0)},
{asof("h1", p.short_ms)},
{asof("h5", p.long_ms)},
{asof("hh", p.hour_ms)},
{asof("hs", p.surge_ms)},
rt as (
  select c.asset_id, c.ord, s.price,
         lag(s.price) over (partition by c.asset_id, c.ord order by s.n) as before
  from cf c join sm s on c.asset_id = s.asset_id and s.recv_ts <= c.recv_ts and s.recv_ts >= c.recv_ts - {p.vol_ms}),
vo as (
  select asset_id, ord, count(*) as pts, count(before) as k, stddev_samp(ln(price / before)) as sd
  from rt group by 1, 2),
st as (
  select c.asset_id, c.recv_ts, c.ord, c.market_id, c.last, c.best_bid, c.best_ask,
         h0.n - h1.n < {p.ring} as f1, h0.n - h5.n < {p.ring} as f5, h0.n - hh.n < {p.ring} as fh,
         h0.n - hs.n < {p.ring} as fs, h1.price as p1, h5.price as p5, hh.price as ph, hs.price as ps,
         vo.pts >= 3 and vo.k >= 2 as fv, vo.sd, ch.seq is not null as changed,
         last_value(ch.seq ignore nulls) over (partition by c.asset_id order by c.recv_ts, c.ord
           rows between unbounded preceding and current row) as seq
  from cf c
  left join h0 on c.asset_id = h0.asset_id and c.ord = h0.ord
  left join h1 on c.asset_id = h1.asset_id and c.ord = h1.ord
  left join h5 on c.asset_id = h5.asset_id and c.ord = h5.ord
  left join hh on c.asset_id = hh.asset_id and c.ord = hh.ord
  left join hs on c.asset_id = hs.asset_id and c.ord = hs.ord
  left join vo on c.asset_id = vo.asset_id and c.ord = vo.ord
  left join ch on c.asset_id = ch.asset_id and c.ord = ch.ord)"""


TICK_COLUMNS = """1 as v, asset_id as a, coalesce(market_id, '') as m, round(last, 6) as p,
  round(coalesce(best_bid, 0), 6) as b, round(coalesce(best_ask, 0), 6) as k,
  round(case when f1 then (last - p1) * 100 else 0 end, 6) as c1m,
  round(case when f5 then (last - p5) * 100 else 0 end, 6) as c5m,
  round(case when fv then sd else 0 end, 6) as vol, seq, recv_ts as rts, recv_ts as pts, ord,
  coalesce(f1, false) as ok_1m, coalesce(f5, false) as ok_5m, coalesce(fv, false) as ok_vol"""

SURGES = f"""cand as (
  select asset_id, recv_ts, ord, coalesce(market_id, '') as market_id, ps as "from", last as "to"
  from st where changed and fs and abs((last - ps) * 100) >= {P.threshold}),
{greedy("fired", "cand", P.cooldown_ms)}"""


def tick_output(df):
    return df.select(
        F.col("v").cast("int").alias("v"), "a", "m", r6("p"), r6("b"), r6("k"), r6("c1m"), r6("c5m"),
        r6("vol"), "seq", "rts", "pts", "ord", "ok_1m", "ok_5m", "ok_vol",
    )


@query("build_ticks", f"with recursive {stats()} select {TICK_COLUMNS} from st where changed")
def build_ticks(spark, sf_dir):
    return tick_output(series.build_ticks(raw_events(spark, sf_dir), P))


SNAP_SQL = f"""with recursive {stats()},
live as (select asset_id, recv_ts, ord from st where last is not null),
{greedy("sn", "live", P.snapshot_ms)}
select {TICK_COLUMNS} from st where (asset_id, ord) in (select asset_id, ord from sn)"""


@query("throttled_snapshots", SNAP_SQL)
def throttled_snapshots(spark, sf_dir):
    return tick_output(series.throttled_snapshots(raw_events(spark, sf_dir), P))


@query("carry_forward", f"""with {EV}, {CARRIED}
select asset_id, recv_ts, ord, market_id, round(price, 6) as price, round(last, 6) as last,
       round(best_bid, 6) as best_bid, round(best_ask, 6) as best_ask from cf""")
def carry_forward(spark, sf_dir):
    rows = series.carry_forward(raw_events(spark, sf_dir), P)
    return rows.select("asset_id", "recv_ts", "ord", "market_id", r6("price"), r6("last"), r6("best_bid"), r6("best_ask"))


@query("usable_price", f"with {EV} select asset_id, recv_ts, ord, round(price, 6) as price from ev where price <> 0")
def usable_price(spark, sf_dir):
    return series.usable_price(raw_events(spark, sf_dir)).select("asset_id", "recv_ts", "ord", r6("price"))


@query("has_price", f"with {EV}, {CARRIED} select asset_id, recv_ts, ord from cf where last is not null")
def has_price(spark, sf_dir):
    return series.has_price(raw_events(spark, sf_dir), P).select("asset_id", "recv_ts", "ord")


@query("price_changes", f"with {EV}, {PRICED}, {CHANGED} select asset_id, recv_ts, ord, round(price, 6) as price, seq from ch")
def price_changes(spark, sf_dir):
    rows = series.price_changes(raw_events(spark, sf_dir), P)
    return rows.select("asset_id", "recv_ts", "ord", r6("price"), F.col("seq").cast("bigint").alias("seq"))


@query("sample_min_gap", f"""with recursive {EV}, {PRICED}, {greedy("sm", "pr", P.gap_ms)}
select asset_id, recv_ts, ord, round(price, 6) as price from sm""")
def sample_min_gap_query(spark, sf_dir):
    return series.samples(raw_events(spark, sf_dir), P).select("asset_id", "recv_ts", "ord", r6("price"))


@query("sample_min_gap_by_user", f"""with recursive u as (
  select user_id, epoch_us(ts) // 1000 as recv_ts, event_id as ord from events),
{greedy("sm", "u", DAY, "user_id")} select user_id, recv_ts, ord from sm""")
def sample_min_gap_by_user(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("recv_ts"), F.col("event_id").alias("ord")
    )
    return sample_min_gap(rows, DAY, key=("user_id",))


@query("retain_last_n", """select l_suppkey, l_orderkey, l_linenumber, l_partkey from (
  select *, row_number() over (partition by l_suppkey
    order by l_orderkey desc, l_linenumber desc, l_partkey desc) as k from lineitem) where k <= 100""")
def retain_last_n(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return series.retain_last_n(lines, 100, key=("l_suppkey",), order=("l_orderkey", "l_linenumber", "l_partkey"))


@query("asof_lookup", f"""with recursive {stats()}
select asset_id, recv_ts, ord, round(last, 6) as last,
       round(case when fs then ps end, 6) as surge_from from st""")
def asof_lookup(spark, sf_dir):
    return series.asof_lookup(raw_events(spark, sf_dir), P).select("asset_id", "recv_ts", "ord", r6("last"), r6("surge_from"))


@query("chg_window", f"""with recursive {stats()}
select asset_id, recv_ts, ord, round(last, 6) as last,
  round(case when f1 then (last - p1) * 100 else 0 end, 6) as c1m, coalesce(f1, false) as ok_1m,
  round(case when f5 then (last - p5) * 100 else 0 end, 6) as c5m, coalesce(f5, false) as ok_5m,
  round(case when fh then (last - ph) * 100 else 0 end, 6) as c1h, coalesce(fh, false) as ok_1h from st""")
def chg_window(spark, sf_dir):
    rows = series.chg_window(raw_events(spark, sf_dir), P)
    return rows.select("asset_id", "recv_ts", "ord", r6("last"), r6("c1m"), "ok_1m", r6("c5m"), "ok_5m", r6("c1h"), "ok_1h")


@query("volatility", f"""with recursive {stats()}
select asset_id, recv_ts, ord, round(case when fv then sd else 0 end, 6) as vol, coalesce(fv, false) as ok_vol from st""")
def volatility(spark, sf_dir):
    return series.volatility(raw_events(spark, sf_dir), P).select("asset_id", "recv_ts", "ord", r6("vol"), "ok_vol")


@query("detect_surges", f"""with recursive {stats()}, {SURGES}
select asset_id, recv_ts, ord, market_id, round("from", 6) as "from", round("to", 6) as "to" from fired""")
def detect_surges(spark, sf_dir):
    rows = series.detect_surges(raw_events(spark, sf_dir), P)
    return rows.select("asset_id", "recv_ts", "ord", "market_id", r6("from"), r6("to"))


MARKETS = """mk as (
  select 'm' || c_custkey as market_id, c_name as question, c_acctbal as volume,
         c_acctbal > 0 as active, c_nationkey = 7 as closed,
         case when c_nationkey < 12 then [c_mktsegment, 'Other'] else [c_mktsegment] end as outcomes,
         case when c_nationkey < 12 then ['click', 'view'] else ['error', 'signup', 'purchase'] end as clob_token_ids
  from customer)"""


@query("build_alerts", f"""with recursive {stats()}, {SURGES}, {MARKETS}
select 1 as v, f.asset_id as a, f.market_id as m, coalesce(k.question, '') as q,
  coalesce(k.outcomes[list_position(k.clob_token_ids, f.asset_id)], '') as outcome,
  round(f."from", 6) as "from", round(f."to", 6) as "to", {P.surge_window_s} as window_s, f.recv_ts as ts
from fired f left join mk k on f.market_id = k.market_id""")
def build_alerts(spark, sf_dir):
    rows = pipeline.build_alerts(raw_events(spark, sf_dir), customer_markets(spark, sf_dir), P)
    return rows.select("v", "a", "m", "q", "outcome", r6("from"), r6("to"), "window_s", "ts")


# The state at an instant: the asset's newest price against its samples.
@query("top_movers", f"""with recursive {EV}, {PRICED}, {greedy("sm", "pr", P.gap_ms)},
l as (select asset_id, arg_max(price, recv_ts) as last from pr where recv_ts <= {JAN_20} group by 1),
h as (select asset_id, arg_max(price, recv_ts) as price, max(n) as n from sm where recv_ts <= {JAN_20 - P.long_ms} group by 1),
z as (select asset_id, max(n) as n from sm where recv_ts <= {JAN_20} group by 1)
select asset_id as a, round((last - price) * 100, 6) as c5m,
  row_number() over (order by abs((last - price) * 100) desc, asset_id) as rank
from l join h using (asset_id) join z using (asset_id) where z.n - h.n < {P.ring}
qualify rank <= {P.top}""")
def top_movers(spark, sf_dir):
    return series.top_movers(raw_events(spark, sf_dir), JAN_20, P).select(
        "a", r6("c5m"), F.col("rank").cast("bigint").alias("rank"))


GRID_SQL = f"""with recursive {EV}, {PRICED}, {greedy("sm", "pr", P.gap_ms)},
g as (select unnest(range({JAN_1}, (select max(recv_ts) from ev) + {6 * HOUR}, {6 * HOUR})) as ts),
ga as (select g.ts, a.asset_id from g, (select distinct asset_id from pr) a),
l as (select ga.ts, ga.asset_id, p.price as last from ga asof join pr p on ga.asset_id = p.asset_id and p.recv_ts <= ga.ts),
h as (select ga.ts, ga.asset_id, s.price, s.n from ga asof join sm s on ga.asset_id = s.asset_id and s.recv_ts <= ga.ts - {P.long_ms}),
z as (select ga.ts, ga.asset_id, s.n from ga asof join sm s on ga.asset_id = s.asset_id and s.recv_ts <= ga.ts)
select ts, asset_id as a, round((last - h.price) * 100, 6) as c5m,
  row_number() over (partition by ts order by abs((last - h.price) * 100) desc, asset_id) as rank
from l join h using (ts, asset_id) join z using (ts, asset_id) where z.n - h.n < {P.ring}
qualify rank <= {P.top}"""


def grid_movers(spark, sf_dir):
    """Every six hours until all events are behind."""
    events = raw_events(spark, sf_dir)
    last = events.agg(F.max("recv_ts")).first()[0]
    return series.top_movers_on_grid(events, JAN_1, last + 6 * HOUR - 1, 6 * HOUR, P)


@query("top_movers_on_grid", GRID_SQL)
def top_movers_on_grid(spark, sf_dir):
    rows = grid_movers(spark, sf_dir)
    return rows.select("ts", "a", r6("c5m"), F.col("rank").cast("bigint").alias("rank"))


@query("top_lists", f"""select ts, count(*) as n, string_agg(a || '=' || printf('%.2f', c5m), '|' order by rank) as shown
from ({GRID_SQL}) group by 1""")
def top_lists(spark, sf_dir):
    """The lists as records, one per instant."""
    rows = grid_movers(spark, sf_dir)
    shown = F.transform("d", lambda e: F.concat(e["a"], F.lit("="), F.format_string("%.2f", e["c5m"])))
    return series.top_lists(rows).select(
        "ts", F.size("d").cast("bigint").alias("n"), F.array_join(shown, "|").alias("shown"))


USER_TICKS = """tk as (
  select 'u' || user_id as a, event_type as m, value as p, value - 0.5 as b, value + 0.5 as k,
         value / 10 as c1m, value - 20 as c5m, value / 1000 as vol, event_id as seq,
         epoch_us(ts) // 1000 as rts, epoch_us(ts) // 1000 as pts from events)"""


@query("movers_from_ticks", f"""with {USER_TICKS},
l as (select a, c5m from tk qualify row_number() over (partition by a order by pts desc, seq desc) = 1)
select a, round(c5m, 6) as c5m, row_number() over (order by abs(c5m) desc, a) as rank from l qualify rank <= 50""")
def movers_from_ticks(spark, sf_dir):
    return series.movers_from_ticks(user_ticks(spark, sf_dir)).select(
        "a", r6("c5m"), F.col("rank").cast("bigint").alias("rank"))


@query("chart_series", f"""with {USER_TICKS},
s as (select m as a, pts // {HOUR} as t, arg_max(p, struct_pack(pts := pts, seq := seq)) as p from tk group by 1, 2)
select a, t, round(p, 6) as p from s qualify row_number() over (partition by a order by t desc) <= 200""")
def chart_series(spark, sf_dir):
    ticks = user_ticks(spark, sf_dir).withColumn("a", F.col("m"))
    return series.chart_series(ticks, 200, HOUR).select("a", "t", r6("p"))


@query("latest_per_key", f"""with {USER_TICKS}
select a, m, round(p, 6) as p, seq, pts from tk
qualify row_number() over (partition by a order by pts desc, seq desc) = 1""")
def latest_per_key(spark, sf_dir):
    return keyed.latest_per_key(user_ticks(spark, sf_dir), ("a",), ("pts", "seq")).select("a", "m", r6("p"), "seq", "pts")


@query("latest_per_key_tombstones", """
select user_id, event_type, event_id from events where event_type <> 'error'
qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def latest_per_key_tombstones(spark, sf_dir):
    """Errors play null records: they never replace or remove a key's value."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    live = F.col("event_type").isNotNull()
    return keyed.latest_per_key(rows, ("user_id",), ("ts", "event_id"), live=live).select("user_id", "event_type", "event_id")


@query("restore_state", f"""with {USER_TICKS},
l as (select m as a, round(p, 6) as p, round(b, 6) as b, round(k, 6) as k, pts from tk
      qualify row_number() over (partition by m order by pts desc, seq desc) = 1)
select l.*, q.seq from l join (select m as a, max(seq) as seq from tk group by 1) q using (a)""")
def restore_state(spark, sf_dir):
    snaps = user_ticks(spark, sf_dir).withColumn("a", F.col("m"))
    return series.restore_state(snaps).select("a", r6("p"), r6("b"), r6("k"), "pts", "seq")


@query("dedupe_ticks", """select l_orderkey as a, l_linenumber as seq from lineitem group by 1, 2""")
def dedupe_ticks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("seq"))
    return keyed.dedupe_ticks(rows)


RESUME_AT = 1_705_276_800_000


@query("build_ticks_resumed", f"""with {EV}, {PRICED}, {CARRIED}, {CHANGED},
i as (select asset_id, max(seq) as seq0 from ch where recv_ts < {RESUME_AT} group by 1)
select ch.asset_id as a, coalesce(cf.market_id, '') as m, round(ch.price, 6) as p,
       round(coalesce(cf.best_bid, 0), 6) as b, round(coalesce(cf.best_ask, 0), 6) as k, ch.seq, ch.recv_ts as pts
from ch join cf on ch.asset_id = cf.asset_id and ch.ord = cf.ord where ch.recv_ts >= {RESUME_AT}""")
def build_ticks_resumed(spark, sf_dir):
    """The second half of the events, started from the first half's last state."""
    events = raw_events(spark, sf_dir)
    rows = series.state_rows(events.filter(F.col("recv_ts") < RESUME_AT), P, marks=events.select("asset_id", "recv_ts", "ord"))
    start = series.restore_state(series.as_ticks(rows.filter("marked and last is not null")))
    late = series.build_ticks(events.filter(F.col("recv_ts") >= RESUME_AT), P, initial=start)
    return late.select("a", "m", r6("p"), r6("b"), r6("k"), "seq", "pts")


# --- frame text to derived records, in one plan ------------------------------
def frame_records(spark, sf_dir):
    events = frames.ordered(frames.parse_frames(event_frames(spark, sf_dir)))
    return pipeline.process(events, customer_markets(spark, sf_dir), P, fit=True)


@query("pipeline_ticks", f"with recursive {stats()} select {TICK_COLUMNS} from st where changed")
def pipeline_ticks(spark, sf_dir):
    rows = frame_records(spark, sf_dir).ticks
    return tick_output(rows.withColumn("ord", F.shiftright("ord", frames.INSIDE_BITS)))


@query("pipeline_alerts", ORACLES["build_alerts"])
def pipeline_alerts(spark, sf_dir):
    """Through a topic: written as records, read back and decoded."""
    path = scratch(spark, "alerts")
    topics.write_topic(frame_records(spark, sf_dir).alerts, path, "a")
    rows, _ = topics.decode_json_records(topics.read_topic_bounded(spark, path).select("value"), ALERT)
    return rows.select("v", "a", "m", "q", "outcome", r6("from"), r6("to"), "window_s", "ts")
