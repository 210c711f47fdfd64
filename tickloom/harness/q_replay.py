"""Recording and replay extraction."""
from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.harness.adapters import HOUR, recording, scratch
from tickloom.harness.registry import query
from tickloom.operators.ranks import global_rank
from tickloom.plans import replay
from tickloom.sources import recording as rec

MS = "epoch_us(ts) // 1000"
LINES = f"""ln as (select event_type = 'error' as is_alert, {MS} as ts, event_id,
  strftime(events.ts, '%Y-%m-%d') as date, strftime(events.ts, '%H') as hour,
  case when event_type = 'error' then '{{"t":"alert","d":{{"a":"error","ts":' || {MS} || '}}}}'
    else '{{"t":"tick","d":{{"a":"' || event_type || '","seq":' || event_id || ',"pts":' || {MS} || '}}}}' end as line from events)"""


def lines(spark, sf_dir):
    """Recording lines of all events, parsed, without going through files."""
    rows = rec.recording_lines(recording(spark, sf_dir)).select("value", "date", "hour")
    return rec.parse_lines(rows)


@query("recording_lines", f"with {LINES} select ts, line as value, date, hour from ln")
def recording_lines(spark, sf_dir):
    return rec.recording_lines(recording(spark, sf_dir))


@query("write_and_read_recording", f"""with {LINES} select ts, case when is_alert then 'alert' else 'tick' end as kind, line, date,
  cast(hour as integer) as hour from ln""")
def write_and_read_recording(spark, sf_dir):
    """Written as gzip text by date and hour, then read back."""
    folder = scratch(spark, "recording")
    rec.write_recording(recording(spark, sf_dir), folder)
    return rec.read_recording(spark, folder).select("ts", "kind", "line", F.col("date").cast("string").alias("date"), "hour")


@query("alert_density", f"with {LINES} select date, hour, count(*) filter (where is_alert) as alerts from ln group by 1, 2")
def alert_density(spark, sf_dir):
    return replay.alert_density(lines(spark, sf_dir))


@query("densest_hour", f"""with {LINES} select date, hour, count(*) filter (where is_alert) as alerts from ln
group by 1, 2 order by alerts desc, date, hour limit 1""")
def densest_hour(spark, sf_dir):
    return replay.densest(replay.alert_density(lines(spark, sf_dir)))


@query("order_recording", f"""with {LINES} select ts, case when is_alert then 'alert' else 'tick' end as kind,
  row_number() over (order by ts, line) - 1 as place from ln""")
def order_recording(spark, sf_dir):
    """Written in order and read back: a line's place is its file's, then its own."""
    folder = scratch(spark, "ordered")
    replay.order_recording(lines(spark, sf_dir), ("ts", "line")).select("ts", "kind").write.parquet(folder)
    rows = spark.read.parquet(folder).select(
        "ts", "kind", F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r")).alias("at"))
    return global_rank(rows, ["at"], "place").select("ts", "kind", (F.col("place") - 1).alias("place"))


@query("clip_stats", f"""with {LINES} select strftime(make_timestamp(min(ts) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as recorded_at,
  cast(floor((max(ts) - min(ts)) / 1000 + 0.5) as bigint) as duration_s from ln""")
def clip_stats(spark, sf_dir):
    return replay.clip_stats(lines(spark, sf_dir))


@query("manifest", f"""with {LINES} select strftime(make_timestamp(min(ts) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as recorded_at,
  cast(floor((max(ts) - min(ts)) / 1000 + 0.5) as bigint) as duration_s, 'replay-2024-01-01-00.ndjson.gz' as file,
  'markets.json' as markets, 'benchmark.json' as benchmark from ln""")
def manifest(spark, sf_dir):
    """Written as one JSON file and read back."""
    folder = scratch(spark, "manifest")
    name = replay.clip_name("2024-01-01", "00")
    rec.write_manifest(replay.manifest(replay.clip_stats(lines(spark, sf_dir)), [name]), folder)
    return rec.read_manifest(spark, folder).select(
        "recorded_at", "duration_s", F.col("files")[0].alias("file"), "markets", "benchmark")


TRIM = """numbered as (select *, row_number() over (order by ts desc, line desc) as newest from {rows}),
cuts(keep) as (select count(*) from {rows} union all
  select greatest(keep * 9 // 10, 1) from cuts where keep > 1),
sized as (select keep, (select sum(strlen(line) + 1) from numbered where newest <= keep) as size from cuts),
best as (select coalesce(max(keep) filter (where size <= {limit}), 1) as keep from sized)"""


@query("trim_to_budget", f"with recursive {LINES}, {TRIM.format(rows='ln', limit=20_000)}"
       "\nselect ts, case when is_alert then 'alert' else 'tick' end as kind, line from numbered, best where newest <= keep")
def trim_to_budget(spark, sf_dir):
    """Measured by raw bytes, which SQL can do as well."""
    return replay.trim_to_budget(
        lines(spark, sf_dir), 20_000, ("ts", "line"), measure=replay.raw_size, block=97
    ).select("ts", "kind", "line")


@query("trim_to_budget_gzip")
def trim_to_budget_gzip(spark, sf_dir):
    """Where the cut falls depends on the packer, so there is no SQL for it."""
    return replay.trim_to_budget(lines(spark, sf_dir), 20_000, ("ts", "line")).select("ts", "kind", "line")


@query("extract_clip_trimmed", f"""with recursive {LINES}, d as (select date, hour from ln group by 1, 2
  order by count(*) filter (where is_alert) desc, date, hour limit 1),
h as (select ts, line from ln join d using (date, hour)),
{TRIM.format(rows='h', limit=300)} select ts, line from numbered, best where newest <= keep""")
def extract_clip_trimmed(spark, sf_dir):
    """The newest lines of the densest hour that fit into 300 bytes."""
    rows = lines(spark, sf_dir).withColumns({"file": F.lit("f"), "pos": F.col("line")})
    clip, _ = replay.extract_clip(rows, max_ms=HOUR, max_bytes=300, measure=replay.raw_size)
    return clip.select("ts", "line")


@query("extract_clip", f"""with {LINES}, d as (select date, hour from ln group by 1, 2
  order by count(*) filter (where is_alert) desc, date, hour limit 1)
select ts, line from ln join d using (date, hour) where ts >= (select max(ts) from ln join d using (date, hour)) - {HOUR // 2}""")
def extract_clip(spark, sf_dir):
    """The last half hour of the densest hour; it is far below the size limit."""
    rows = lines(spark, sf_dir).withColumns({"file": F.lit("f"), "pos": F.col("ts")})
    clip, _ = replay.extract_clip(rows, max_ms=HOUR // 2)
    return clip.select("ts", "line")


@query("replay_schedule", f"""with {LINES}, o as (select min(ts) as a, max(ts) as b from ln)
select ts, event_id, lap, round((ts - a) / 5.0::double + lap * ((b - a) / 5.0::double), 6) as due_ms
from (select ts, event_id from ln where not is_alert), o, (values (0), (1)) l(lap)""")
def replay_schedule(spark, sf_dir):
    """Five times the speed, two laps; the schedule spans ticks and alerts."""
    due = replay.replay_schedule(lines(spark, sf_dir), 5.0, 2)
    event = F.get_json_object("data", "$.seq").cast("bigint").alias("event_id")
    return due.filter(F.col("kind") == "tick").select("ts", event, "lap", F.round("due_ms", 6).alias("due_ms"))


@query("replay_schedule_speed_change", f"""with {LINES}, o as (select min(ts) as a from ln)
select ts, event_id, round(case when ts - a <= 1000000 then (ts - a) * 1.0::double else 1000000 + (ts - a - 1000000) / 20.0::double end, 6) as due_ms
from (select ts, event_id from ln where not is_alert), o""")
def replay_schedule_speed_change(spark, sf_dir):
    due = replay.replay_schedule(lines(spark, sf_dir), 1.0, changes=((1_000_000, 20.0),))
    event = F.get_json_object("data", "$.seq").cast("bigint").alias("event_id")
    return due.filter(F.col("kind") == "tick").select("ts", event, F.round("due_ms", 6).alias("due_ms"))
