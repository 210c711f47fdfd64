import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import BASE, EVENT
from tests.fold import fold, greedy
from tickloom.operators import series
from tickloom.operators import axis
from tickloom.operators.axis import Axis, running
from tickloom.operators.gap import sample_min_gap
from tickloom.params import Params
from tickloom.plans.pipeline import process

TICK = ["a", "m", "p", "b", "k", "c1m", "c5m", "vol", "seq", "rts", "ord", "ok_1m", "ok_5m", "ok_vol"]


def rounded(df):
    rows = df.withColumn("vol", F.round("vol", 8)).select(*TICK).collect()
    return sorted(tuple(r) for r in rows)


def random_events(seed, n, span_ms, assets):
    rng = random.Random(seed)
    return [
        (
            rng.choice(assets), rng.choice(["", "m1", "m2"]),
            0.0 if rng.random() < 0.2 else round(rng.uniform(0.3, 0.6), 2),
            rng.choice([0.0, 0.3, 0.4]), rng.choice([0.0, 0.5, 0.6]),
            BASE + rng.randrange(span_ms) // 20 * 20, i,
        )
        for i in range(n)
    ]


CASES = {
    "dense": (Params(slice_ms=300_000), random_events(5, 3_000, 1_200_000, "aaab")),
    "small ring": (Params(ring=20, vol_ms=15_000, slice_ms=40_000), random_events(6, 2_000, 1_000_000, "aab")),
    "sparse": (Params(slice_ms=100_000), random_events(7, 1_000, 30_000_000, "ab")),
}


@pytest.mark.parametrize("case", CASES)
def test_matches_the_fold(spark, case):
    p, rows = CASES[case]
    events = spark.createDataFrame(rows, EVENT).repartition(3)
    ticks, snaps, alerts = fold(rows, p)
    assert rounded(series.build_ticks(events, p)) == ticks
    assert rounded(series.throttled_snapshots(events, p)) == snaps
    assert sorted(tuple(r) for r in series.detect_surges(events, p).collect()) == alerts
    changes = series.price_changes(events, p).select("asset_id", "recv_ts", "ord", "seq").collect()
    assert sorted(tuple(r) for r in changes) == sorted((t[0], t[9], t[10], t[8]) for t in ticks)


def test_result_does_not_depend_on_slices(spark):
    _, rows = CASES["dense"]
    events = spark.createDataFrame(rows, EVENT)
    one, many = Params(slice_ms=10_000_000), Params(slice_ms=7_000)
    assert rounded(series.build_ticks(events, one)) == rounded(series.build_ticks(events, many))


def test_hot_asset_is_cut(spark):
    """One asset with nearly all rows still spreads over many groups."""
    _, rows = CASES["dense"]
    cut = Axis(width=60_000).cut(spark.createDataFrame(rows, EVENT))
    assert cut.filter("asset_id = 'a'").select("_slice").distinct().count() >= 20


def test_slices_are_fitted_to_the_busiest_asset(spark):
    p, rows = CASES["dense"]
    events = spark.createDataFrame(rows, EVENT)
    fitted = series.fit_slices(events, p, 200)
    assert fitted.slice_ms < p.slice_ms
    cut = Axis(width=fitted.slice_ms).cut(events).groupBy("asset_id", "_slice").count()
    assert cut.agg(F.max("count")).first()[0] <= 200
    assert series.fit_slices(events, p, 10**9).slice_ms >= p.slice_ms // 64 * 64


def test_whole_pipeline(spark):
    p, rows = CASES["dense"]
    events = spark.createDataFrame(rows, EVENT)
    markets = spark.createDataFrame(
        [("m1", "Will X happen?", ["Yes", "No"], ["a", "b"])],
        "market_id string, question string, outcomes array<string>, clob_token_ids array<string>")
    out = process(events, markets, p, at=BASE + 900_000, keep_rows=True)
    ticks, snaps, alerts = fold(rows, p)
    assert rounded(out.ticks) == ticks and rounded(out.snapshots) == snaps
    got = sorted((r.a, r.ts, r.q, r.outcome) for r in out.alerts.collect())
    label = {("m1", "a"): ("Will X happen?", "Yes"), ("m1", "b"): ("Will X happen?", "No")}
    assert got == sorted((a[0], a[1], *label.get((a[3], a[0]), ("", ""))) for a in alerts)
    assert out.top.count() == 2


# --- golden values ---------------------------------------------------------
def test_ring_keeps_the_newest_900(make_events):
    kept = series.retain_last_n(series.samples(make_events([(i, i + 1) for i in range(950)])), 900)
    prices = sorted(r.price - 1 for r in kept.collect())
    assert (len(prices), prices[0], prices[-1]) == (900, 50, 949)


def test_sampler_throttles_and_keeps_an_exact_gap(make_events):
    kept = series.samples(make_events([(0, 1), (0.2, 2), (0.999, 3), (1.0, 4)]))
    assert sorted(r.price for r in kept.collect()) == [1, 4]


def test_asof_at_exact_between_and_before(make_events):
    p = Params(surge_ms=2_000)
    rows = series.asof_lookup(make_events([(i, i + 1) for i in range(10)] + [(9.4, 50)]), p).collect()
    by_price = {r.last: r.surge_from for r in rows}
    assert by_price[8.0] == 6.0  # exactly on a sample
    assert by_price[50.0] == 8.0  # between samples
    assert by_price[2.0] is None  # before the first


def test_volatility_hand_computed(make_events):
    rows = series.volatility(make_events(list(enumerate([0.5, 0.5, 0.6, 0.6, 0.5]))), Params(vol_ms=10_000))
    last = rows.orderBy(F.desc("recv_ts")).first()
    assert last.ok_vol and math.isclose(last.vol, 0.1488649278, abs_tol=1e-9)


def test_volatility_needs_three_samples_and_is_zero_when_flat(make_events):
    short = series.volatility(make_events([(0, 0.5), (1, 0.5)])).orderBy(F.desc("recv_ts")).first()
    assert not short.ok_vol and short.vol == 0.0
    flat = series.volatility(make_events([(i, 0.5) for i in range(5)])).orderBy(F.desc("recv_ts")).first()
    assert flat.ok_vol and flat.vol == 0.0


def test_change_windows(make_events):
    points = [(i, 0.40) for i in range(61)] + [(i, 0.50) for i in range(61, 301)]
    last = series.chg_window(make_events(points)).orderBy(F.desc("recv_ts")).first()
    assert last.ok_1m and last.c1m == 0.0
    assert last.ok_5m and math.isclose(last.c5m, 10, abs_tol=1e-9)
    assert not last.ok_1h and last.c1h == 0.0


def test_first_sample_has_no_statistics(make_events):
    row = series.build_ticks(make_events([(0, 0.5)])).first()
    assert (row.seq, row.ok_1m, row.ok_5m, row.ok_vol) == (1, False, False, False)


def test_surge_fires_once_until_the_cooldown_is_over(make_events):
    flat = [(i, 0.40) for i in range(60)]
    surge = [(60, 0.43), (60.1, 0.55), (61, 0.56), (180.05, 0.70), (180.1, 0.75)]
    fired = series.detect_surges(make_events(flat + surge)).orderBy("recv_ts").collect()
    assert [(r["from"], r["to"]) for r in fired] == [(0.40, 0.55), (0.56, 0.75)]


def test_threshold_compares_doubles(make_events):
    """0.40 -> 0.45 is 4.999999999999999 points and does not fire at 5."""
    flat = [(i, 0.40) for i in range(61)]
    assert series.detect_surges(make_events(flat + [(61, 0.45)])).count() == 0
    flat = [(i, 0.25) for i in range(61)]
    assert series.detect_surges(make_events(flat + [(61, 0.30)]), Params(threshold=(0.30 - 0.25) * 100)).count() == 1


def test_dedupe_and_snapshot_throttle(make_events):
    events = make_events([(0, 0.40), (0.1, 0.40), (1.1, 0.40), (1.2, 0.41)])
    ticks = series.build_ticks(events).orderBy("rts").collect()
    assert [(t.rts - BASE, t.seq) for t in ticks] == [(0, 1), (1200, 2)]
    snaps = series.throttled_snapshots(events).orderBy("rts").collect()
    assert [s.rts - BASE for s in snaps] == [0, 1100]


def test_restored_state_continues_without_a_first_change(spark, make_events):
    start = series.restore_state(series.throttled_snapshots(make_events([(0, 0.40), (2, 0.42)])))
    assert start.first().seq == 2
    ticks = series.build_ticks(make_events([(10, 0.42), (11, 0.43)]), initial=start).collect()
    assert [(t.p, t.seq) for t in ticks] == [(0.43, 3)]


def test_top_movers_order(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", -9.0), ("c", 4.0), ("d", -2.0), ("e", 0.0)], "a string, c5m double")
    assert [r.a for r in series.rank_movers(rows, 3).orderBy("rank").collect()] == ["b", "c", "d"]
    assert series.rank_movers(rows, 0).count() == 5


def test_top_movers_at_and_on_the_grid_agree(spark):
    p, rows = CASES["dense"]
    events = spark.createDataFrame(rows, EVENT)
    at = BASE + 900_000
    one = sorted((r.a, r.c5m, r["rank"]) for r in series.top_movers(events, at, p).collect())
    grid = series.top_movers_on_grid(events, at - 60_000, at, 60_000, p).filter(F.col("ts") == at)
    assert sorted((r.a, r.c5m, r["rank"]) for r in grid.collect()) == one and one


# --- properties ------------------------------------------------------------
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 400)), min_size=1, max_size=120),
    st.sampled_from([1, 7, 40]),
)
def test_sampler_equals_the_greedy_rule(spark, points, gap):
    rows = [(k, t, i) for i, (k, t) in enumerate(points)]
    df = spark.createDataFrame(rows, "asset_id string, recv_ts bigint, ord bigint")
    for width in (None, 4 * gap):
        assert sorted(tuple(r) for r in sample_min_gap(df, gap, width=width).collect()) == greedy(rows, gap)


def test_sampler_over_many_slices(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("xyz"), rng.randrange(60_000_000), i) for i in range(15_000)]
    df = spark.createDataFrame(rows, "asset_id string, recv_ts bigint, ord bigint")
    assert sorted(tuple(r) for r in sample_min_gap(df, 1_000).collect()) == greedy(rows, 1_000)


def test_sampler_regular_dense_rows(spark):
    """Regular rows never let two starting points meet: the hardest case."""
    df = spark.range(40_000).selectExpr("'h' as asset_id", "id * 10 as recv_ts", "id as ord")
    kept = [r.recv_ts for r in sample_min_gap(df, 105, width=1_000).orderBy("recv_ts").collect()]
    assert kept == list(range(0, 400_000, 110))


def test_running_values(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), t, rng.choice([None, 1, 2, 3])) for t in rng.sample(range(5_000), 400)]
    df = spark.createDataFrame(rows, "k string, t bigint, v int")
    got = running(
        df, Axis(("k",), ("t",), 300), sums={"s": F.col("v")}, lasts={"l": F.col("v")},
        before={"b": F.col("v")}, after={"a": F.col("v")},
    ).collect()
    for r in got:
        mine = sorted((t, v) for k, t, v in rows if k == r.k and v is not None)
        upto = [v for t, v in mine if t <= r.t]
        prior, later = [v for t, v in mine if t < r.t], [v for t, v in mine if t > r.t]
        assert r.s == sum(upto) and r.l == (upto or [None])[-1]
        assert r.b == (prior or [None])[-1] and r.a == (later or [None])[0]
    assert len(got) == len(rows)


def test_running_values_without_a_key(spark, monkeypatch):
    monkeypatch.setattr(axis, "BLOCK", 4)  # many blocks of slices
    rng = random.Random(5)
    rows = [(t, rng.choice([None, 1, 2, 3])) for t in rng.sample(range(-2_000, 3_000), 300)]
    got = running(
        spark.createDataFrame(rows, "t bigint, v int"), Axis((), ("t",), 50), sums={"s": F.col("v")},
        lasts={"l": F.col("v")}, before={"b": F.col("v")}, after={"a": F.col("v")},
    ).collect()
    mine = sorted((t, v) for t, v in rows if v is not None)
    for r in got:
        prior, later = [v for t, v in mine if t < r.t], [v for t, v in mine if t > r.t]
        upto = [v for t, v in mine if t <= r.t]
        assert (r.s, r.l) == (sum(upto), (upto or [None])[-1])
        assert (r.b, r.a) == ((prior or [None])[-1], (later or [None])[0])
    assert len(got) == len(rows)
