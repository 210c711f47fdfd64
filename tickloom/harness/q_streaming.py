"""Streaming forms, run over the whole table to its end and read back."""
from __future__ import annotations

import time

from pyspark.sql import functions as F

from tickloom.harness.adapters import HOUR, P, customer_markets, customer_subs, messages, ms, raw_events, scratch
from tickloom.harness.q_frames import event_output, mixed_sql
from tickloom.harness.q_series import EV, GRID_SQL, MARKETS, PRICED, SNAP_SQL, SURGES, TICK_COLUMNS, USER_TICKS, stats, tick_output
from tickloom.harness.q_serving import ALERTS, CAPPED, CONFLATED, MS, SUBS, USER_FANOUT, snapshot_ops
from tickloom.harness.registry import ORACLES, query, r6
from tickloom.operators import joins, keyed, serving, telemetry
from tickloom import schemas
from tickloom.sources import frames, recording as rec, topics
from tickloom.streaming import chart, jobs, processor, replay
from tickloom.streaming import serving as live
from tickloom.streaming import telemetry as stats_stream
from tickloom.harness import adapters, q_telemetry  # noqa: F401  (its check SQL is used here)


class Streaming:
    """A session whose parquet reads are file streams, to reuse the adapters."""

    def __init__(self, spark):
        self.spark = spark
        self.read = self

    def parquet(self, path):
        schema = self.spark.read.parquet(path).schema
        # a pattern matching just this name: a stream takes a folder or a pattern
        return self.spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def finished(spark, stream, name):
    path = scratch(spark, name)
    jobs.run_to_end(stream, path + "/out", path + "/checkpoint")
    return spark.read.schema(stream.schema).parquet(path + "/out")


def upserted(spark, stream, name, key, order):
    path = scratch(spark, name)
    jobs.latest_table(stream, path + "/table", path + "/checkpoint", key, order, once=True, mode="update").awaitTermination()
    return jobs.read_latest(spark, path + "/table", key, order)


def derived(spark, sf_dir):
    return finished(spark, processor.derive_stream(raw_events(Streaming(spark), sf_dir), P), "derived")


@query("stream_ticks", f"with recursive {stats()} select {TICK_COLUMNS} from st where changed")
def stream_ticks(spark, sf_dir):
    return tick_output(processor.ticks_of(derived(spark, sf_dir)))


@query("stream_snapshots", SNAP_SQL)
def stream_snapshots(spark, sf_dir):
    return tick_output(processor.ticks_of(derived(spark, sf_dir), "snapshot"))


@query("stream_alerts", f"""with recursive {stats()}, {SURGES}
select asset_id as a, recv_ts as ts, market_id as m, round("from", 6) as "from", round("to", 6) as "to" from fired""")
def stream_alerts(spark, sf_dir):
    """All three outputs of one stateful pass; the alerts are read back."""
    path = scratch(spark, "sinks")
    q = jobs.derived_sinks(raw_events(Streaming(spark), sf_dir), customer_markets(spark, sf_dir), path + "/out",
                           path + "/checkpoint", P, once=True)
    q.awaitTermination()
    return spark.read.parquet(path + "/out/alerts").select("a", "ts", "m", r6("from"), r6("to"))


@query("stream_top", f"select * from ({GRID_SQL}) where ts <= (select max(epoch_us(ts) // 1000) from events)")
def stream_top(spark, sf_dir):
    """The top list at every sixth hour the stream has passed, from event-time timers."""
    path = scratch(spark, "top")
    rows = processor.derive_stream(raw_events(Streaming(spark), sf_dir), P, every=6 * HOUR)
    jobs.top_table(processor.movers_of(rows), path + "/table", path + "/checkpoint", P.top, once=True).awaitTermination()
    ranked = jobs.read_top(spark, path + "/table", P.top)
    return ranked.select("ts", "a", r6("c5m"), F.col("rank").cast("bigint").alias("rank"))


@query("stream_latest_per_key", f"""with {USER_TICKS} select a, seq, pts from tk
qualify row_number() over (partition by a order by pts desc, seq desc) = 1""")
def stream_latest_per_key(spark, sf_dir):
    path = scratch(spark, "latest")
    stream = adapters.user_ticks(Streaming(spark), sf_dir).select("a", "seq", "pts")
    jobs.latest_table(stream, path + "/table", path + "/checkpoint", ("a",), ("pts", "seq"), once=True).awaitTermination()
    return jobs.read_latest(spark, path + "/table", ("a",), ("pts", "seq"))


@query("stream_frames", mixed_sql("", "p in ('1', '2', '3')"))
def stream_frames(spark, sf_dir):
    return event_output(finished(spark, frames.parse_frames(adapters.mixed_frames(Streaming(spark), sf_dir)), "frames"))


@query("stream_dedupe_ticks", "select distinct event_type as a, user_id as seq from events")
def stream_dedupe_ticks(spark, sf_dir):
    rows = adapters.table(Streaming(spark), sf_dir, "events").select(
        F.col("event_type").alias("a"), F.col("user_id").alias("seq"), ms("ts").alias("pts"))
    return finished(spark, keyed.dedupe_ticks(rows, "40 days"), "dedupe").select("a", "seq")


@query("stream_rates", f"""with r as (select event_type, (epoch_us(ts) // 1000 // {6 * HOUR}) * {6 * HOUR} as start from events)
select event_type, start, count(*) as n from r group by 1, 2""")
def stream_rates(spark, sf_dir):
    """All windows, the open one included."""
    rows = adapters.table(Streaming(spark), sf_dir, "events").select("event_type", ms("ts").alias("ms"))
    return upserted(spark, jobs.rates(rows, "ms", "6 hours", "0 seconds", ("event_type",)), "rates",
                    ("event_type", "start"), ("n",))


@query("stream_fanout", f"with {SUBS} select client_id, ord, ts, value from dl")
def stream_fanout(spark, sf_dir):
    """A message stream joined with the static subscription table."""
    rows = serving.fanout_join(messages(Streaming(spark), sf_dir), customer_subs(spark, sf_dir))
    return finished(spark, rows.select("client_id", "ord", "ts", "value"), "fanout")


@query("stream_conflate", f"""with {SUBS}, w as (select client_id, id, value, ts, (ts // {6 * HOUR}) * {6 * HOUR} as flush from dl)
select client_id, flush, id, arg_max(value, ts) as value from w group by 1, 2, 3""")
def stream_conflate(spark, sf_dir):
    rows = serving.fanout_join(messages(Streaming(spark), sf_dir), customer_subs(spark, sf_dir))
    out = upserted(spark, jobs.conflated(rows, "6 hours", "0 seconds"), "conflate",
                   ("client_id", "flush", "ch", "id"), ("ts", "ord"))
    return out.select("client_id", "flush", "id", "value")


@query("stream_enrich_alerts", f"""with {ALERTS}, {MARKETS}
select a.ord, coalesce(k.question, '') as question,
  coalesce(k.outcomes[list_position(k.clob_token_ids, a.asset_id)], '') as outcome
from al a left join mk k on a.market_id = k.market_id""")
def stream_enrich_alerts(spark, sf_dir):
    from tickloom.harness.q_serving import event_alerts

    rows = joins.enrich_alerts(event_alerts(Streaming(spark), sf_dir), customer_markets(spark, sf_dir))
    return finished(spark, rows.select("ord", "question", "outcome"), "alerts")


@query("stream_recording", """select strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H')::integer as hour, count(*) as n from events group by 1, 2""")
def stream_recording(spark, sf_dir):
    path = scratch(spark, "recording")
    q = rec.write_recording(adapters.recording(Streaming(spark), sf_dir), path + "/out", checkpoint=path + "/checkpoint", once=True)
    q.awaitTermination()
    rows = rec.read_recording(spark, path + "/out")
    return rows.groupBy(F.col("date").cast("string").alias("date"), "hour").agg(F.count("line").alias("n"))


@query("stream_topic", """select cast(event_id as varchar) as asset_id, event_type as kind, epoch_us(ts) // 1000 as src_ts from events""")
def stream_topic(spark, sf_dir):
    """Events written as a JSON record stream, read back as a stream and decoded."""
    path = scratch(spark, "topic")
    rows = adapters.table(Streaming(spark), sf_dir, "events").select(
        F.col("event_id").cast("string").alias("asset_id"), F.col("event_type").alias("kind"),
        ms("ts").alias("src_ts"), F.lit(0.0).alias("price"))
    topics.write_topic(rows, path + "/topic", "asset_id", checkpoint=path + "/c1", omit_zero=topics.RAW_OPTIONAL,
                       once=True).awaitTermination()
    back = topics.read_topic(spark, path + "/topic", streaming=True)
    good, _ = topics.decode_json_records(back.select("value"), schemas.RAW_EVENT)
    return finished(spark, good.select("asset_id", "kind", "src_ts"), "decoded")


@query("stream_counts", "select event_type, count(*) as n from events group by 1")
def stream_counts(spark, sf_dir):
    """Running totals, complete mode, into a table the last batch leaves behind."""
    path = scratch(spark, "counts")
    rows = jobs.counts(adapters.table(Streaming(spark), sf_dir, "events"), "event_type")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(path + "/out")

    rows.writeStream.outputMode("complete").option("checkpointLocation", path + "/c").trigger(
        availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(path + "/out")


@query("stream_pipeline_ticks", f"with recursive {stats()} select {TICK_COLUMNS} from st where changed")
def stream_pipeline_ticks(spark, sf_dir):
    """Frame text to ticks in one stream; the ticks go through a topic and come back."""
    events = frames.ordered(frames.parse_frames(adapters.event_frames(Streaming(spark), sf_dir)))
    path = scratch(spark, "pipeline")
    jobs.derived_sinks(
        events, customer_markets(spark, sf_dir), path + "/out", path + "/checkpoint", P, once=True, topics=path + "/topics",
    ).awaitTermination()
    back = topics.read_topic_bounded(spark, path + "/topics/ticks")
    sent, _ = topics.decode_json_records(back.select("value"), schemas.TICK)
    rows = spark.read.parquet(path + "/out/ticks").join(
        sent.select("a", "seq", F.col("p").alias("_p")), ["a", "seq"]).filter(F.col("p") == F.col("_p"))
    return tick_output(rows.withColumn("ord", F.shiftright("ord", frames.INSIDE_BITS)))


# --- stateful serving ------------------------------------------------------
@query("stream_fanout_changing", USER_FANOUT)
def stream_fanout_changing(spark, sf_dir):
    """Messages and subscription requests as two streams."""
    source = Streaming(spark)
    rows = live.stream_fanout(messages(source, sf_dir), adapters.user_ops(source, sf_dir))
    return finished(spark, rows, "changing").select("client_id", "id", "ts", "ord", "value")


@query("stream_subscription_steps", f"with recursive {CAPPED} select * from capped")
def stream_subscription_steps(spark, sf_dir):
    rows = live.stream_steps(adapters.order_ops(Streaming(spark), sf_dir), cap=2)
    return finished(spark, rows, "steps").select("client_id", "ch", "id", "ts", "ord", "step", "error")


@query("stream_subscription_counts", ORACLES["subscription_counts"])
def stream_subscription_counts(spark, sf_dir):
    return finished(spark, live.stream_subscription_counts(adapters.order_ops(Streaming(spark), sf_dir)), "counts")


@query("stream_conflate_frames", CONFLATED)
def stream_conflate_frames(spark, sf_dir):
    """Every window is sent by its timer; a clock a year ahead closes the last ones."""
    source = Streaming(spark)
    rows = serving.fanout_join(messages(source, sf_dir), customer_subs(spark, sf_dir))
    ticking = adapters.clock(source, sf_dir, 1_735_689_600_000).select(
        F.lit(0).cast("bigint").alias("client_id"), F.lit(None).cast("string").alias("ch"), F.lit(None).cast("string").alias("id"),
        "ts", F.lit(0).cast("bigint").alias("ord"), F.lit(None).cast("string").alias("value"))
    sent = live.stream_conflate(rows.unionByName(ticking), 6 * HOUR)
    return finished(spark, sent, "frames").withColumn("n", F.col("n").cast("bigint"))


@query("stream_sys_stats", ORACLES["sys_stats"])
def stream_sys_stats(spark, sf_dir):
    source = Streaming(spark)
    events = adapters.table(source, sf_dir, "events").select(
        ms("ts").alias("ts"), F.col("event_id").alias("ord"), F.col("value").alias("latency_ms"), "event_type")
    opened = F.lit(1_704_067_200_000) + F.call_function("div", F.col("c_custkey") * HOUR, F.lit(10))
    closed = opened + F.col("c_nationkey").cast("bigint") * adapters.DAY
    steps = adapters.table(source, sf_dir, "customer").select(F.explode(F.array(
        F.struct(opened.alias("ts"), F.lit(1).alias("step")), F.struct(closed.alias("ts"), F.lit(-1).alias("step")))).alias("s"))
    rows = stats_stream.stream_sys_stats(
        events, events.filter("event_type = 'view'"), steps.select("s.*"), window_ms=adapters.DAY, last=700, parts=8,
        clock=adapters.clock(source, sf_dir, 1_767_225_600_000))
    out = finished(spark, rows, "sys")
    return out.select("start", "clients", r6("in_eps"), r6("out_mps"), r6("p99_ms"))


@query("stream_chart_series", ORACLES["chart_series"])
def stream_chart_series(spark, sf_dir):
    ticks = adapters.user_ticks(Streaming(spark), sf_dir).withColumn("a", F.col("m"))
    made = finished(spark, chart.stream_chart(ticks, 200, HOUR), "chart")
    return chart.chart_now(made, 200).select("a", "t", r6("p"))


@query("stream_snapshots_on_subscribe", ORACLES["snapshot_on_subscribe"])
def stream_snapshots_on_subscribe(spark, sf_dir):
    """Requests and messages as two streams; a clock a year ahead sends the last answers."""
    source = Streaming(spark)
    ticking = adapters.clock(source, sf_dir, 1_767_225_600_000).select(
        F.lit("asset").alias("ch"), F.lit("clock").alias("id"), "ts", F.lit(0).cast("bigint").alias("ord"), F.lit("").alias("value"))
    rows = live.stream_snapshots(
        snapshot_ops(source, sf_dir), messages(source, sf_dir).unionByName(ticking), cap=500, parts=4)
    sent = finished(spark, rows, "snapshots")
    return sent.select("client_id", "ts", "t", F.col("n").cast("bigint").alias("n"), "frame")


@query("stream_pipeline_counters", ORACLES["stream_counters"])
def stream_pipeline_counters(spark, sf_dir):
    """The totals of three streams, complete mode."""
    source, path = Streaming(spark), scratch(spark, "counters")
    rows = telemetry.pipeline_counters(q_telemetry.counted(source, sf_dir))

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(path + "/out")

    rows.writeStream.outputMode("complete").option("checkpointLocation", path + "/c").trigger(
        availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(path + "/out")


#: Milliseconds a lap of the replay below takes.
LAP_MS = 1_500


@query("stream_replay", f"""with o as (select min({MS}) as a, max({MS}) - min({MS}) as span from events)
select {MS} as ts, event_id as ord, lap::bigint as lap, round(({MS} - a) / (span / {LAP_MS}.0::double)
  + lap * (span / (span / {LAP_MS}.0::double)), 6) as due_ms, true as in_time
from events, o, (values (0), (1)) l(lap)""")
def stream_replay(spark, sf_dir):
    """All events as a clip, two laps, played by timers of the clock."""
    rows = lambda source: adapters.table(source, sf_dir, "events").select(
        ms("ts").alias("ts"), F.col("event_id").alias("ord"), F.col("event_type").alias("value"))
    origin, span = rows(spark).agg(F.min("ts"), F.max("ts") - F.min("ts")).first()
    start, path = int(time.time() * 1000) + 3_000, scratch(spark, "replay")
    played = replay.stream_replay(rows(Streaming(spark)), origin, span, start, speed=span / LAP_MS, laps=2, parts=8)
    replay.play_to_end(played, path + "/out", path + "/checkpoint", start + 2 * LAP_MS)
    out = spark.read.schema(played.schema).parquet(path + "/out")
    return out.select("ts", "ord", "lap", r6("due_ms"), (F.col("played_ms") >= start + F.col("due_ms")).alias("in_time"))
