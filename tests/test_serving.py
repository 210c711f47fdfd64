import random

from pyspark.sql import functions as F

from tickloom.operators import joins, ranks, serving, telemetry
from tickloom.operators.keyed import latest_per_key
from tickloom.plans import replay

OPS = "client_id bigint, ts bigint, ord bigint, op string, ch string, ids array<string>"


def steps(df):
    return [tuple(r) for r in df.select("client_id", "ts", "id", "step", "error").orderBy("ts", "ord", "id").collect()]


def test_cap_rejects_whole_requests(spark):
    ops = [
        (1, 1, 1, "sub", "asset", ["a", "b", "c"]), (1, 2, 2, "sub", "asset", ["a", "b"]),
        (1, 3, 3, "sub", "asset", ["c"]), (1, 4, 4, "sub", "asset", ["a"]),
        (1, 5, 5, "unsub", "asset", ["a", "zz"]), (1, 6, 6, "sub", "asset", ["c", "c"]),
        (1, 7, 7, "sub", "top", []), (1, 8, 8, "close", None, None), (1, 9, 9, "sub", "asset", ["a", "b"]),
    ]
    got = steps(serving.apply_subscription_ops(spark.createDataFrame(ops, OPS), 2, 4))
    assert got == [
        (1, 1, None, 0, "too_many_subs"), (1, 2, "a", 1, None), (1, 2, "b", 1, None),
        (1, 3, None, 0, "too_many_subs"), (1, 5, "a", -1, None), (1, 6, None, 0, "too_many_subs"),
        (1, 7, "", 1, None), (1, 8, "", -1, None), (1, 8, "b", -1, None), (1, 9, "a", 1, None), (1, 9, "b", 1, None),
    ]


def test_fold_and_windows_agree(spark):
    rng = random.Random(4)
    ops = [
        (rng.randrange(3), t, i, *rng.choice([
            ("sub", "asset", rng.sample("abcd", 2)), ("sub", "top", []), ("unsub", "asset", rng.sample("abcd", 2)),
            ("unsub", "top", []), ("close", None, None), ("ping", None, None)]))
        for i, t in enumerate(sorted(rng.choices(range(300), k=300)))
    ]
    df = spark.createDataFrame(ops, OPS)
    assert steps(serving.apply_subscription_ops(df, 0, 20)) == steps(serving.apply_subscription_ops(df, 99, 20))


def feed(spark, rng, n=400):
    rows = [("asset", rng.choice("aaab"), rng.randrange(1_000), i, f'{{"n":{i}}}') for i in range(n)]
    return rows, spark.createDataFrame(rows, "ch string, id string, ts bigint, ord bigint, value string")


def subs(spark, rng, n=40):
    rows = []
    for c in range(n):
        a, b = sorted(rng.sample(range(1_000), 2))
        rows.append((c, "asset", rng.choice("ab"), a, rng.choice([-1, 10**6]), b if rng.random() < 0.7 else serving.FAR,
                     rng.choice([-1, 10**6])))
    schema = "client_id bigint, ch string, id string, start bigint, start_ord bigint, end bigint, end_ord bigint"
    return rows, spark.createDataFrame(rows, schema)


def test_fanout_with_and_without_spreading(spark):
    rng = random.Random(8)
    messages, m = feed(spark, rng)
    intervals, s = subs(spark, rng)
    want = sorted(
        (c, o) for _, i, t, o, _ in messages for c, _, k, a, ao, b, bo in intervals
        if i == k and (a, ao) <= (t, o) < (b, bo))
    plain = serving.fanout_join(m, s)
    spread = serving.fanout_join(m, s, hot=joins.hot_keys(m, ("ch", "id"), 50))
    for df in (plain, spread):
        assert sorted((r.client_id, r.ord) for r in df.collect()) == want


def test_reducing_before_fanout_changes_nothing(spark):
    rng = random.Random(10)
    _, m = feed(spark, rng)
    _, s = subs(spark, rng)
    for flush in (1, 50, 400):
        late = serving.conflate(serving.fanout_join(m, s), flush)
        early = serving.conflate(serving.conflate_before_fanout(m, s, flush), flush)
        assert sorted(map(tuple, late.collect())) == sorted(map(tuple, early.collect()))


def test_conflation_keeps_the_newest(spark):
    rows = [(1, "asset", "a", 10, 1, '{"s":1}'), (1, "asset", "a", 20, 2, '{"s":2}'), (1, "asset", "a", 30, 3, '{"s":3}')]
    df = spark.createDataFrame(rows, "client_id bigint, ch string, id string, ts bigint, ord bigint, value string")
    assert [r.frame for r in serving.conflate(df, 100).collect()] == ['{"t":"ticks","d":[{"s":3}]}']


def test_snapshot_on_subscribe_knows_only_cached_ids(spark):
    ops = spark.createDataFrame([(1, 50, 1, "sub", "asset", ["a1", "nope"]), (2, 5, 2, "sub", "asset", ["a1"])], OPS)
    ticks = spark.createDataFrame([("a1", 10, 1, '{"p":1}'), ("a1", 20, 2, '{"p":2}'), ("a1", 60, 3, '{"p":3}')],
                                  "id string, ts bigint, ord bigint, value string")
    got = serving.snapshot_on_subscribe(ops, ticks).collect()
    assert [(r.client_id, r.frame) for r in got] == [(1, '{"t":"snap","d":[{"p":2}]}')]


def test_rate_limit(spark):
    connects = spark.createDataFrame([(1, 0), (2, 0)], "client_id bigint, ts bigint")
    log = [(1, 10 * i, i) for i in range(25)] + [(2, 60 * i, 100 + i) for i in range(40)]
    found = serving.rate_limit_violations(connects, spark.createDataFrame(log, "client_id bigint, ts bigint, ord bigint"))
    assert [(r.client_id, r.ts, r.ord) for r in found.collect()] == [(1, 200, 20)]


def test_full_runs(spark):
    flags = "0110111011111"
    rows = [(1, i, c == "1") for i, c in enumerate(flags)] + [(2, i, i % 3 != 0) for i in range(12)]
    df = spark.createDataFrame(rows, "client_id bigint, cycle bigint, full boolean")
    assert [tuple(r) for r in serving.consecutive_full_runs(df, 3, 4).collect()] == [(1, 6)]


def test_partition_lag_keeps_silent_partitions(spark):
    polls = [(1, 0, 150, 49), (1, 1, 10, 9), (2, 1, 20, 19), (3, 0, 150, 149)]
    df = spark.createDataFrame(polls, "poll bigint, partition int, hwm bigint, last_offset bigint")
    assert [tuple(r) for r in telemetry.partition_lag(df, 2).orderBy("poll").collect()] == [(1, 100), (2, 100), (3, 0)]


def test_nearest_rank(spark):
    rng = random.Random(2)
    values = [float(rng.randrange(300)) for _ in range(1_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    got = {r.p: r.value for r in ranks.nearest_rank_percentile(df, "v", (0.0, 0.5, 0.99, 1.0)).collect()}
    order = sorted(values)
    assert got == {p: order[min(int(len(order) * p), len(order) - 1)] for p in (0.0, 0.5, 0.99, 1.0)}
    none = telemetry.recent_percentile(df.filter("v < 0"), "v", ("v",)).first()
    assert (none.n, none.value) == (0, 0.0)


def test_chunks_and_global_rank(spark):
    ids = spark.createDataFrame([(f"a{i}",) for i in (3, 1, 5, 2, 4, 1)], "asset_id string")
    got = ranks.assign_chunks(ids, 2).orderBy("position").collect()
    assert [(r.asset_id, r.chunk) for r in got] == [("a1", 0), ("a2", 0), ("a3", 1), ("a4", 1), ("a5", 2)]


def test_tombstones_never_win(spark):
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, None)], "k string, t int, v string")
    assert latest_per_key(rows, ("k",), ("t",), live=F.col("v").isNotNull()).first().v == "x"


def test_replay_times_and_looping(spark):
    rows = spark.createDataFrame([(1_000,), (1_600,), (2_500,)], "ts bigint")
    due = replay.replay_schedule(rows, 1.0, 2).orderBy("lap", "ts").collect()
    assert [r.due_ms for r in due] == [0, 600, 1_500, 1_500, 2_100, 3_000]
    fast = replay.replay_schedule(rows, 1.0, changes=((100, 5.0),)).orderBy("ts").collect()
    assert [r.due_ms for r in fast] == [0, 200, 380]


def test_trim_keeps_the_newest_lines_that_fit(spark):
    rng = random.Random(1)
    rows = [(t, f'{{"t":"tick","d":{rng.getrandbits(200)}}}') for t in range(600)]
    df = spark.createDataFrame(rows, "ts bigint, line string")
    kept = [r.ts for r in replay.trim_to_budget(df, 8_000, ("ts",)).orderBy("ts").collect()]
    assert kept == list(range(600 - len(kept), 600)) and 100 < len(kept) < 300
    assert replay.trim_to_budget(df, 1, ("ts",)).count() == 1
    assert replay.trim_to_budget(df, 10**9, ("ts",)).count() == 600


def test_asof_join_ties_and_keys(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 4, 2), ("b", 9, 3)], "k string, t bigint, n int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y")], "k string, u bigint, v string")
    rows = joins.asof_join(left, right, ("k",), "t", "u", width=2).orderBy("n").collect()
    assert [r.hit.v if r.hit else None for r in rows] == ["x", "y", None]


def intervals_of(spark, rows):
    return spark.createDataFrame(rows, "client_id long, ch string, id string, start long, start_ord long, end long, end_ord long")


def feed_of(spark, times):
    return spark.createDataFrame([("asset", "a", t, i, f"v{i}") for i, t in enumerate(times)],
                                 "ch string, id string, ts long, ord long, value string")


def test_fanout_by_buckets_equals_fanout_by_key(spark):
    rng = random.Random(9)
    rows, times = [], [rng.randrange(-50_000, 10**9) for _ in range(400)]
    for c in range(400):
        start = rng.choice([rng.randrange(-50_000, 10**9), rng.choice(times)])
        length = rng.choice([0, 1, 999, 1000, 1001, 15_999, 16_000, 16_001, 10**6, 10**8])
        end = serving.FAR if c % 4 == 0 else start + length
        rows.append((c, "asset", "a", start, rng.randrange(400), end, serving.FAR if end == serving.FAR else rng.randrange(400)))
    feed, subs = feed_of(spark, times), intervals_of(spark, rows)
    shown = lambda df: sorted(map(tuple, df.collect()))
    want = shown(serving.fanout_join(feed, subs, bucket_ms=None))
    assert want and shown(serving.fanout_join(feed, subs, bucket_ms=1000)) == want
    hot = spark.createDataFrame([("asset", "a", 3)], "ch string, id string, parts int")
    assert shown(serving.fanout_join(feed, subs, bucket_ms=1000, hot=hot)) == want
    assert serving.fanout_join(feed, intervals_of(spark, [])).count() == 0


def test_fanout_does_not_meet_a_keys_past(spark):
    """Thousands of closed intervals: what is compared grows with the deliveries."""
    rows = [(c, "asset", "a", c * 1000, 0, c * 1000 + 1500, 0) for c in range(5000)]
    feed, subs = feed_of(spark, range(0, 5_000_000, 2500)), intervals_of(spark, rows)
    delivered = serving.fanout_join(feed, subs, bucket_ms=1000).count()
    compared = serving.fanout_pairs(feed, subs, bucket_ms=1000).count()
    assert delivered >= 2500 and compared < 30 * delivered
    assert serving.fanout_pairs(feed, subs, bucket_ms=None).count() == 5000 * 2000


def test_percentiles_by_narrowing(spark):
    rng, inf = random.Random(3), float("inf")
    ps = (0.0, 0.25, 0.5, 0.99, 1.0)
    cases = [
        [rng.gauss(0, 1) for _ in range(500)], [1.0] * 40 + [2.0], [5e-324, 0.0, 1e-323, -5e-324] * 5, [0.0, -0.0, 1.0],
        [1e308, -1e308, 1.7e308, -1.7e308, 3.0], [-inf, 1.0, inf, inf, 2.0], [float(rng.randrange(4)) for _ in range(99)],
        [1.0 + k * 2.0 ** -52 for k in range(300)] + [1e300], [7.0], [None, 3.0, None],
    ]
    for values in cases:
        known = sorted(v for v in values if v is not None)
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = {r.p: (r.n, r.value) for r in ranks.narrowed_percentile(df, "v", ps, buckets=16).collect()}
        assert got == {p: (len(known), known[min(int(len(known) * p) + 1, len(known)) - 1]) for p in ps}
    empty = spark.createDataFrame([(None,)], "v double")
    assert ranks.narrowed_percentile(empty, "v", ps).collect() == []
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    low, high = sorted(ranks.narrowed_percentile(nan, "v", (0.0, 1.0)).collect())
    assert low.value == 1.0 and high.value != high.value
