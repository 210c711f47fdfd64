"""Stateful serving operators over several micro-batches and restarts, against the batch forms."""
import random
import time

import pytest
from pyspark.sql import functions as F

from tickloom.operators import series, serving, telemetry
from tickloom.plans.replay import replay_schedule
from tickloom.streaming import chart, jobs, replay
from tickloom.streaming import serving as streams
from tickloom.streaming import telemetry as stats

OPS = "client_id long, ts long, ord long, op string, ch string, ids array<string>"
MSG = "ch string, id string, ts long, ord long, value string"
DELIVERY = "client_id long, ch string, id string, ts long, ord long, value string"


def requests(seed, n=120, clients=5, span=30_000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = rng.choices(["sub", "unsub", "close"], [6, 3, 1])[0]
        ch = rng.choice(["asset", "asset", "top"])
        ids = rng.choices("abcd", k=rng.randint(0, 3)) if ch == "asset" else None
        rows.append((rng.randrange(clients), rng.randrange(1, span // 50) * 50, i, op, ch, ids))
    return sorted(rows, key=lambda r: r[1])


def feed(seed, n=300, span=30_000):
    rng = random.Random(seed)
    # nothing at the epoch itself: the watermark starts there
    rows = [(("top", "") if rng.random() < 0.2 else ("asset", rng.choice("abcde"))) + (rng.randrange(1, span // 50) * 50,) for _ in range(n)]
    return [(c, k, t, 1000 + i, f"v{i}") for i, (c, k, t) in enumerate(sorted(rows, key=lambda r: r[2]))]


class Source:
    """Rows put into a folder in time order, one file at a time, each run of the stream after the
    last in a new query from the same checkpoint."""

    def __init__(self, spark, folder, schema, rows, at, cuts):
        self.spark, self.folder, self.schema, self.rows, self.at, self.cuts = spark, str(folder), schema, rows, at, cuts
        spark.createDataFrame([], schema).write.parquet(self.folder)

    def put(self, step):
        low, high = self.cuts[step], self.cuts[step + 1]
        rows = [r for r in self.rows if low <= r[self.at] < high]
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        time.sleep(0.02)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


CUTS = [-1, 9_000, 20_000, 30_000, 10**12]


def run_in_steps(spark, tmp_path, sources, build):
    for step in range(len(CUTS) - 1):
        for source in sources:
            source.put(step)
        jobs.run_to_end(build(*[s.stream() for s in sources]), str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.parquet(str(tmp_path / "out"))


def same(got, want):
    columns = sorted(want.columns)
    shown = lambda df: sorted(str([r[c] for c in columns]) for r in df.collect())
    a, b = shown(got), shown(want)
    assert sorted(set(a) ^ set(b)) == [] and a == b and a


@pytest.mark.parametrize("parts", [1, 3])
def test_fanout_while_subscriptions_change(spark, tmp_path, parts):
    ops, msgs = requests(1), feed(2)
    sources = [Source(spark, tmp_path / "m", MSG, [*msgs, ("asset", "z", 90_000, 1, "clock")], 2, CUTS),
               Source(spark, tmp_path / "o", OPS, ops, 1, CUTS)]
    got = run_in_steps(spark, tmp_path, sources, lambda m, o: streams.stream_fanout(m, o, parts=parts))
    intervals = serving.subscription_intervals(spark.createDataFrame(ops, OPS), 5_000)
    same(got, serving.fanout_join(spark.createDataFrame(msgs, MSG), intervals))


def test_capped_steps_and_counts(spark, tmp_path):
    ops = requests(3)
    clock = (99, 90_000, 10_000, "none", None, None)
    source = Source(spark, tmp_path / "o", OPS, [*ops, clock], 1, CUTS)
    got = run_in_steps(spark, tmp_path, [source], lambda o: streams.stream_steps(o, cap=3))
    want = serving.apply_subscription_ops(spark.createDataFrame(ops, OPS), 3, 5_000)
    same(got, want)
    assert want.filter("error is not null").count()
    again = tmp_path / "counts"
    again.mkdir()
    source = Source(spark, again / "o", OPS, [*ops, clock], 1, CUTS)
    got = run_in_steps(spark, again, [source], lambda o: streams.stream_subscription_counts(o))
    same(got, serving.subscription_counts(serving.apply_subscription_ops(spark.createDataFrame(ops, OPS), 0, 5_000), 5_000))


def test_conflation_by_timers(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(3), c, k, t, o, v) for c, k, t, o, v in feed(5)]
    rows += [(c, rng.choice(["alerts", "sys"]), "", t, o + 5000, f"s{o}") for c, _, _, t, o, _ in rows[::7]]
    clock = (0, None, None, 90_000, 1, None)
    source = Source(spark, tmp_path / "d", DELIVERY, sorted([*rows, clock], key=lambda r: r[3]), 3, CUTS)
    got = run_in_steps(spark, tmp_path, [source], lambda d: streams.stream_conflate(d, 700))
    same(got, serving.conflate(spark.createDataFrame(rows, DELIVERY), 700))


def test_sys_stats_over_restarts(spark, tmp_path):
    rng = random.Random(6)
    ins = sorted((rng.randrange(1, 30_000), i, rng.choice([None, -1.0, *[round(rng.random() * 90, 3)] * 8])) for i in range(400))
    outs = sorted((rng.randrange(5_000, 30_000),) for _ in range(200))
    people = [(i, rng.randrange(1, 20_000), rng.choice([None, 25_000 + i * 40])) for i in range(30)]
    steps = sorted([(a, 1) for _, a, _ in people] + [(b, -1) for _, _, b in people if b is not None])
    kinds = {"i": "ts long, ord long, latency_ms double", "o": "ts long", "s": "ts long, step int", "c": "ts long"}
    made = dict(zip("iosc", (ins, outs, steps, [(90_000,)])))
    sources = [Source(spark, tmp_path / k, kinds[k], made[k], 0, CUTS) for k in "iosc"]
    got = run_in_steps(spark, tmp_path, sources, lambda i, o, s, c: stats.stream_sys_stats(
        i, o, s, window_ms=1000, last=50, parts=4, clock=c))
    want = telemetry.sys_stats(
        spark.createDataFrame(ins, kinds["i"]), spark.createDataFrame(outs, kinds["o"]),
        spark.createDataFrame(people, "client_id long, start long, end long"), window_ms=1000, last=50, order=("ts", "ord"))
    same(got.withColumn("clients", F.col("clients").cast("int")), want.withColumn("clients", F.col("clients").cast("int")))


def test_chart_after_every_micro_batch(spark, tmp_path):
    rng = random.Random(8)
    schema = "a string, pts long, seq long, p double"
    rows = [(rng.choice("ab"), rng.randrange(1, 30_000), i, round(rng.random(), 3)) for i in range(300)]
    source = Source(spark, tmp_path / "t", schema, rows, 1, CUTS)
    for step in range(len(CUTS) - 1):
        source.put(step)
        jobs.run_to_end(chart.stream_chart(source.stream(), 8, 500), str(tmp_path / "out"), str(tmp_path / "cp"))
        so_far = spark.createDataFrame([r for r in rows if r[1] < CUTS[step + 1]], schema)
        same(chart.chart_now(spark.read.parquet(str(tmp_path / "out")), 8), series.chart_series(so_far, 8, 500))


@pytest.mark.parametrize(("cap", "parts"), [(0, 1), (3, 3)])
def test_snapshots_while_messages_flow(spark, tmp_path, cap, parts):
    ops = [(c, t, i, op, ch, [*(ids or []), "nobody"]) for c, t, i, op, ch, ids in requests(9)]
    msgs = feed(10)
    sources = [Source(spark, tmp_path / "m", MSG, [*msgs, ("asset", "z", 90_000, 1, "clock")], 2, CUTS),
               Source(spark, tmp_path / "o", OPS, ops, 1, CUTS)]
    got = run_in_steps(spark, tmp_path, sources, lambda m, o: streams.stream_snapshots(o, m, cap=cap, parts=parts))
    asked, known = spark.createDataFrame(ops, OPS), spark.createDataFrame(msgs, MSG)
    steps = serving.apply_subscription_ops(asked, cap, 5_000) if cap else None
    want = serving.snapshot_on_subscribe(
        asked, known.filter("ch = 'asset'"), known.filter("ch = 'top'"), width=5_000, steps=steps)
    same(got, want)
    assert {r["t"] for r in got.select("t").distinct().collect()} == {"snap", "top"}


def test_replay_by_timers_over_a_restart(spark, tmp_path):
    rng = random.Random(11)
    schema = "ts long, ord long, value string"
    rows = [(rng.randrange(5_000, 25_000) // 10 * 10, i, f"v{i}") for i in range(200)]
    clip = spark.createDataFrame(rows, schema)
    clip.write.parquet(str(tmp_path / "clip"))
    origin, span = min(r[0] for r in rows), max(r[0] for r in rows) - min(r[0] for r in rows)
    start, changes = int(time.time() * 1000) + 2_000, ((1_000.0, 10.0),)

    def playing():
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "clip"))
        return replay.stream_replay(source, origin, span, start, speed=5.0, laps=2, changes=changes, parts=2)

    first = playing().writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="100 milliseconds").start()
    out = lambda: spark.read.schema(first_schema).parquet(str(tmp_path / "out"))
    first_schema = playing().schema
    limit = time.time() + 60
    while time.time() < limit and not (tmp_path / "out" / "_spark_metadata").exists() or out().isEmpty():
        time.sleep(0.1)
    first.stop()
    replay.play_to_end(playing(), str(tmp_path / "out"), str(tmp_path / "cp"), start + 6_000)
    want = replay_schedule(clip, 5.0, 2, changes)
    same(out().select("ts", "ord", "value", "lap", F.round("due_ms", 6).alias("due_ms")),
         want.select("ts", "ord", "value", F.col("lap").cast("long").alias("lap"), F.round("due_ms", 6).alias("due_ms")))
    assert out().filter(F.col("played_ms") < start + F.col("due_ms")).isEmpty()
    # a row due later is never played earlier
    for part in (0, 1):
        mine = sorted((r["due_ms"], r["played_ms"]) for r in out().filter(F.col("part") == part).collect())
        assert [p for _, p in mine] == sorted(p for _, p in mine)
