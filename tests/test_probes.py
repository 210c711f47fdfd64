"""Cases the check tables do not hold."""
import json
import random
import time
import zlib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.test_frames import BOOK, PAGE, TRADE, parse
from tickloom.functions import numbers
from tickloom.operators import series, serving
from tickloom.params import Params
from tickloom.plans import replay
from tickloom.sources import frames, markets
from tickloom.streaming import jobs, processor

NEW = {"event_type": "new_market", "id": 3}


@pytest.mark.parametrize("frame, events", [
    ([{**NEW, "price": 0.5}, TRADE], 1),
    ([{"event_type": "best_bid_ask", "best_bid": 0.4}, TRADE], 1),
    ({**TRADE, "extra": {"size": 5, "bids": "x"}}, 1),
    ({**TRADE, "best_bid": 0.4}, 1),
    ({**TRADE, "bids": 7}, 1),
    ([{**NEW, "bids": [5], "price_changes": {"a": 1}}, BOOK], 1),
    ({**BOOK, "side": 5, "bids": None}, 1),
    ([None, TRADE], 1),
    ({**TRADE, "market": None}, 1),
])
def test_fields_of_other_types_do_not_reject_a_frame(spark, frame, events):
    assert len(parse(spark, json.dumps(frame))) == events


@pytest.mark.parametrize("frame", [
    {**TRADE, "side": 5}, {**BOOK, "bids": [{"price": 1}]}, {**BOOK, "bids": [5]}, {**BOOK, "asks": {}},
    {"event_type": "price_change", "price_changes": [{"best_bid": 0.5}]}, {"event_type": 7}, [TRADE, "text"],
    [{**TRADE, "price": 1}, TRADE],
])
def test_mistyped_fields_of_its_own_type_reject_a_frame(spark, frame):
    rows = spark.createDataFrame([(json.dumps(frame), 1)], "frame string, recv_ts bigint")
    elements, rejected = frames.decode_frames(rows)
    assert elements.count() == 0 and rejected.count() == 1


def test_second_look_gives_the_same_values(spark):
    for element in (TRADE, BOOK):
        plain = parse(spark, json.dumps(element))
        assert parse(spark, json.dumps({**element, "extra": {"price": 1}})) == plain


def test_failfast_survives_pruning(spark):
    pages = spark.createDataFrame([json.dumps({**PAGE[0], "outcomes": "oops"})], "string")
    rows = pages.select(F.from_json("value", markets.MARKET_PAGE).alias("p")).select("p.*")
    with pytest.raises(Exception, match="cannot decode outcomes"):
        markets.normalize_markets(rows).select("market_id").collect()


def test_hours_and_iso_text_ignore_the_session_time_zone(spark):
    at = [0, 1_704_067_199_999, 1_711_846_800_123, -1]
    rows = spark.createDataFrame([(t,) for t in at], "t bigint")
    want = [datetime.fromtimestamp(t / 1000, timezone.utc) for t in at]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            date, hour = numbers.hour_of("t")
            got = rows.select("t", date.alias("d"), hour.alias("h"), numbers.iso_millis("t").alias("i")).collect()
            for r, w in zip(got, want):
                assert (r.d, r.h) == (w.strftime("%Y-%m-%d"), w.strftime("%H"))
                assert r.i == w.strftime("%Y-%m-%dT%H:%M:%S.") + f"{r.t % 1000:03d}Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_subscription_counts_only_while_it_lasts(spark):
    ticks = spark.createDataFrame([("a", t, t) for t in range(10)] + [("b", 5, 50)], "a string, ts bigint, ord bigint")
    spans = [("c1", "asset", "a", 2, -1, 4, -1), ("c2", "asset", "a", 3, -1, 6, 6), ("c1", "top", "", 0, -1, serving.FAR, serving.FAR),
             ("c3", "asset", "a", 8, 8, serving.FAR, serving.FAR)]
    intervals = spark.createDataFrame(spans, "client_id string, ch string, id string, start bigint, start_ord bigint, "
                                             "end bigint, end_ord bigint")
    got = serving.subscribed_only(ticks, intervals, width=3).collect()
    assert sorted((r.a, r.ts) for r in got) == [("a", t) for t in (2, 3, 4, 5, 8, 9)]


def test_rejected_requests_get_no_snapshot(spark):
    ops = spark.createDataFrame(
        [("c", 1, 1, "sub", "asset", ["x"]), ("c", 2, 2, "sub", "asset", ["x", "y", "z"])],
        "client_id string, ts bigint, ord bigint, op string, ch string, ids array<string>")
    ticks = spark.createDataFrame([("x", 0, 0, "1")], "id string, ts bigint, ord bigint, value string")
    steps = serving.apply_subscription_ops(ops, cap=2)
    assert serving.snapshot_on_subscribe(ops, ticks).count() == 2
    assert [r.ts for r in serving.snapshot_on_subscribe(ops, ticks, steps=steps).collect()] == [1]


def test_order_numbers(spark):
    rows = spark.createDataFrame([(5, 0, 1), (5, 1, 0), (6, 0, 0), (0, 0, 0)], "offset bigint, pos int, sub int")
    got = frames.ordered(rows).orderBy("ord").collect()
    assert [(r.offset, r.pos, r["sub"]) for r in got] == [(0, 0, 0), (5, 0, 1), (5, 1, 0), (6, 0, 0)]
    with pytest.raises(Exception, match="pos of an event is out of range"):
        frames.ordered(spark.createDataFrame([(1, 1 << 10, 0)], "offset bigint, pos int, sub int")).collect()


def test_latest_table_over_restarts(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema, want = "k int, n bigint", {}
    for batch in range(4):
        rows = [(k, batch * 10) for k in ([0, 1, 2, 3, 4, 5, 6, 7] if batch == 0 else [batch % 2])]
        want |= dict(rows)
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.latest_table(stream, table, str(tmp_path / "ckpt"), ("k",), ("n",), once=True).awaitTermination()
        assert {r.k: r.n for r in jobs.read_latest(spark, table, ("k",), ("n",)).collect()} == want


def test_tables_of_streams_without_rows(spark, tmp_path):
    """No movers yet is a normal state: an empty list with its columns."""
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "ts bigint, a string, c5m double"
    spark.createDataFrame([], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    jobs.top_table(stream, table, str(tmp_path / "c"), 3, once=True).awaitTermination()
    got = jobs.read_top(spark, table, 3)
    assert got.collect() == [] and got.columns == ["ts", "a", "c5m", "rank"]
    jobs.latest_table(stream, table + "2", str(tmp_path / "c2"), ("a",), ("ts",), once=True).awaitTermination()
    assert jobs.read_latest(spark, table + "2", ("a",), ("ts",)).collect() == []


def lines(spark, n):
    rng = random.Random(n)
    rows = [(i, f"line {i} " + "".join(rng.choices("abcdef", k=rng.randint(1, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, "ts bigint, line string")


def kept(df):
    return sorted(r["ts"] for r in df.collect())


def test_trimming_does_not_depend_on_partitions(spark):
    rows, before = lines(spark, 700), spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for parts in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(kept(replay.trim_to_budget(rows.repartition(int(parts)), 9000, ("ts",), block=50)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2] and 1 < len(results[0]) < 700


def test_trimming_equals_one_stream_within_a_block(spark):
    rows = lines(spark, 500).collect()
    for limit in (10, 300, 5000, 10**6):
        keep = len(rows)
        while keep > 1:
            text = b"".join(r["line"].encode() + b"\n" for r in rows[len(rows) - keep:])
            packer = zlib.compressobj(9, zlib.DEFLATED, 31)
            if len(packer.compress(text) + packer.flush()) <= limit:
                break
            keep = max(keep * 9 // 10, 1)
        got = kept(replay.trim_to_budget(spark.createDataFrame(rows), limit, ("ts",)))
        assert got == [r["ts"] for r in rows[len(rows) - keep:]]


def test_trimming_by_blocks_adds_up(spark):
    rows = lines(spark, 300)
    whole = sum(len(r["line"]) + 1 for r in rows.collect())
    for limit in (whole, whole - 1, whole // 3, 1):
        one = kept(replay.trim_to_budget(rows, limit, ("ts",), measure=replay.raw_size))
        assert one == kept(replay.trim_to_budget(rows, limit, ("ts",), measure=replay.raw_size, block=7))
    assert kept(replay.trim_to_budget(rows.limit(0), 10, ("ts",))) == []


def test_stream_top_over_many_batches_equals_the_batch_lists(spark, tmp_path):
    rng = random.Random(6)
    p = Params(gap_ms=1000, ring=20, short_ms=2000, long_ms=5000, vol_ms=5000, surge_ms=2000, cooldown_ms=3000,
               snapshot_ms=1000, top=2, slice_ms=10_000)
    rows = sorted(
        (rng.randint(0, 40_000), rng.choice("abcd"), round(rng.uniform(0.1, 0.9), 3)) for _ in range(300)
    )
    schema = "asset_id string, market_id string, price double, best_bid double, best_ask double, recv_ts bigint, ord bigint"
    data = [(a, "m", x, 0.0, 0.0, 1_000_000 + t, i) for i, (t, a, x) in enumerate(rows)]
    source = str(tmp_path / "in")
    for k in range(0, 300, 60):
        spark.createDataFrame(data[k:k + 60], schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)  # files are taken in the order of their times
    late = [("a", "m", 0.99, 0.0, 0.0, 1_000_500, 1000)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    table = str(tmp_path / "table")
    query = jobs.top_table(
        processor.movers_of(processor.derive_stream(stream, p, every=1000)), table, str(tmp_path / "c"), p.top,
        once=True)
    query.awaitTermination()
    got = jobs.read_top(spark, table, p.top)
    want = series.top_movers_on_grid(spark.createDataFrame(data, schema), 1_000_000, data[-1][5], 1000, p)
    shown = lambda df: sorted((r.ts, r.a, round(r.c5m, 6)) for r in df.collect())
    assert shown(got) == shown(want) and len({r.ts for r in got.collect()}) > 20
    dropped = sum(int(s["numRowsDroppedByWatermark"]) for b in query.recentProgress for s in b["stateOperators"])
    assert dropped == 1  # the late event
