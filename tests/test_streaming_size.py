"""Streams over more rows than they take at once, against plain results."""
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from tests.test_streaming_serving import DELIVERY, MSG, OPS, same
from tickloom.operators import serving as batch
from tickloom.params import Params
from tickloom.plans.replay import replay_schedule
from tickloom.streaming import jobs, processor, replay, serving
from tickloom.streaming.ordered import in_order, timed


def test_replay_goes_on_until_all_is_played(spark, tmp_path, monkeypatch):
    """However late it is, and from many chunks of many runs."""
    monkeypatch.setattr(replay, "RUN", 30)
    monkeypatch.setattr(replay, "CHUNK", 7)
    rng = random.Random(13)
    schema = "ts long, ord long, value string"
    rows = [(rng.randrange(5_000, 6_000), i, rng.choice([None, f"v{i}"])) for i in range(200)]
    clip = spark.createDataFrame(rows, schema)
    clip.write.parquet(str(tmp_path / "clip"))
    origin, span = min(r[0] for r in rows), max(r[0] for r in rows) - min(r[0] for r in rows)
    start = int(time.time() * 1000) - 100_000  # the play should have ended long ago
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        playing = replay.stream_replay(
            spark.readStream.schema(schema).parquet(str(tmp_path / "clip")), origin, span, start, laps=2, parts=2)
        replay.play_to_end(playing, str(tmp_path / "out"), str(tmp_path / "cp"), start + 2 * span)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.read.schema(playing.schema).parquet(str(tmp_path / "out"))
    same(got.select("ts", "ord", "value", "lap", F.round("due_ms", 6).alias("due_ms")),
         replay_schedule(clip, 1.0, 2).select(
             "ts", "ord", "value", F.col("lap").cast("long").alias("lap"), F.round("due_ms", 6).alias("due_ms")))


def test_rows_of_an_asset_are_sorted_in_pieces(monkeypatch):
    monkeypatch.setattr(processor, "SORTED", 100)
    monkeypatch.setattr(processor, "PIECE", 7)
    rng = random.Random(14)
    rows = [(rng.randrange(300), i, rng.random(), 0.0, 0.0, rng.choice("ab")) for i in range(3_000)]
    rng.shuffle(rows)
    frames = [pd.DataFrame(rows[at:at + 40], columns=processor._EVENT) for at in range(0, len(rows), 40)]
    got = list(processor.in_time_order(iter(frames)))
    assert [tuple(r) for f in got for r in f.itertuples(index=False)] == sorted(rows)
    # a frame is full or takes one more piece of each run
    assert len(got) > 5 and max(map(len, got)) <= 100 + 30 * 7
    assert list(processor.in_time_order(iter([]))) == []


def test_pieces_do_not_change_results(spark, tmp_path, monkeypatch):
    rng = random.Random(15)
    schema = "asset_id string, market_id string, price double, best_bid double, best_ask double, recv_ts bigint, ord bigint"
    rows = [(rng.choice("aab"), rng.choice(["", "m"]), rng.choice([0.0, 0.2, 0.5, 0.9]), 0.0, rng.choice([0.0, 0.6]),
             rng.randrange(1, 4_000) * 100, i) for i in range(2_500)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))

    def derived(name):
        made = processor.derive_stream(
            spark.readStream.schema(schema).parquet(str(tmp_path / "in")), Params(), every=10_000, late_ms=5_000)
        jobs.run_to_end(made, str(tmp_path / name / "out"), str(tmp_path / name / "cp"))
        got = spark.read.schema(made.schema).parquet(str(tmp_path / name / "out"))
        return got.withColumns({c: F.round(c, 6).alias(c) for c in ("c1m", "c5m", "vol", "surge_from")})

    want = derived("whole")
    monkeypatch.setattr(processor, "SORTED", 100)
    monkeypatch.setattr(processor, "PIECE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        same(derived("pieces"), want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["kind"] for r in want.select("kind").distinct().collect()} >= {"tick", "alert", "snapshot", "grid"}


def test_state_calls_follow_slots_and_not_keys(spark, tmp_path):
    """Many clients in few groups: the state holds some rows a slot and none a client."""
    ops = [(c, 1_000 + c, c, "sub", "asset", ["a", f"k{c % 7}"]) for c in range(2_000)] + [(0, 90_000, 1, "none", None, None)]
    asked = spark.createDataFrame(ops, OPS)
    asked.write.parquet(str(tmp_path / "in"))
    rows = timed(spark.readStream.schema(OPS).parquet(str(tmp_path / "in")), "0 seconds")
    made = in_order(rows, ("client_id",), serving.Requests(1, "bigint"), slots=5)
    query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert held and max(held) <= 5 * 10
    got = spark.read.schema(made.schema).parquet(str(tmp_path / "out"))
    # a request for two keys is over the cap of one
    assert got.count() == 2_000 and got.filter("error = 'too_many_subs'").count() == 2_000


def test_conflation_calls_no_python_for_a_delivery(spark, tmp_path):
    spark.createDataFrame([], DELIVERY).write.parquet(str(tmp_path / "in"))
    sent = serving.stream_conflate(spark.readStream.schema(DELIVERY).parquet(str(tmp_path / "in")), 700)
    assert "Python" not in sent._jdf.queryExecution().logical().toString()
    assert "InPandas" not in sent._jdf.queryExecution().logical().toString()


def test_open_subscriptions_take_two_buckets(spark, monkeypatch):
    """They end with the last message there is, whatever comes after."""
    seen, covered = [], batch._covered
    monkeypatch.setattr(batch, "_covered", lambda *args: seen.append(args) or covered(*args))
    messages = [("asset", "a", t, t, f"v{t}") for t in range(0, 400_000, 1_000)]
    opened = [(c, "asset", "a", c * 3_000, 0, batch.FAR, batch.FAR) for c in range(200)]
    intervals = spark.createDataFrame(
        opened, "client_id long, ch string, id string, start long, start_ord long, end long, end_ord long")
    got = batch.fanout_join(spark.createDataFrame(messages, MSG), intervals)
    want = sorted((o[0], m[2]) for m in messages for o in opened if (o[3], o[4]) <= (m[2], m[3]))
    assert sorted((r["client_id"], r["ts"]) for r in got.collect()) == want
    assert intervals.select(F.max(F.size(covered(*seen[0])))).first()[0] <= 2
