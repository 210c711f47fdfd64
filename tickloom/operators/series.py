"""Per-asset time series: carried state, change detection, look-backs, surges.

All of it is event time. Input rows are raw events with an ``ord`` column that
breaks ties of ``recv_ts``; a zero price, bid or ask and an empty market id mean
"absent" and never overwrite what is known.

:func:`state_rows` is the one heavy plan. Rows are shuffled once, by
``(asset_id, slice)``. Each slice also receives

* one seed row: the state left by all earlier slices, and the newest sample too
  old for the halo;
* the retained samples of the look-back before the slice (the halo). Samples are
  at least ``gap_ms`` apart, so the halo is small whatever the event rate;
* optionally mark rows (which event is a snapshot) and grid rows (instants at
  which the state is wanted).

After that every statistic is an incremental window frame over the slice. Log
returns are summed over the samples alone, before they meet the events.
"""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.axis import SLICE, Axis, running, slice_expr
from tickloom.operators.gap import sample_min_gap
from tickloom.operators.keyed import latest_per_key
from tickloom.operators.ranks import global_rank
from tickloom.params import Params
from tickloom.session import durable
from tickloom.schemas import RECORD_VERSION

_SEED, _SAMPLE, _MARK, _EVENT, _GRID = range(5)
_KEY = "asset_id"
_FIRST = Window.unboundedPreceding


def present(col: str | Column, absent: object = 0) -> Column:
    """``col`` with the absent marker (and null) as null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nullif(col, F.lit(absent))


def usable_price(events: DataFrame) -> DataFrame:
    return events.filter(F.col("price") != 0)


def _known(events: DataFrame) -> DataFrame:
    return events.filter(F.col(_KEY).isNotNull()).select(
        _KEY,
        F.col("recv_ts").cast("bigint").alias("recv_ts"),
        F.col("ord").cast("bigint").alias("ord"),
        present("market_id", "").alias("market_id"),
        present("price", 0.0).alias("price"),
        present("best_bid", 0.0).alias("best_bid"),
        present("best_ask", 0.0).alias("best_ask"),
    )


def carry_forward(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Events with the asset's newest known market, bid, ask and price."""
    axis = Axis(width=p.slice_ms)
    known = {
        "market_id": present("market_id", ""),
        "last": present("price", 0.0),
        "best_bid": present("best_bid", 0.0),
        "best_ask": present("best_ask", 0.0),
    }
    return running(events, axis, lasts=known)


def has_price(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Events at or after the first priced event of their asset."""
    rows = running(events, Axis(width=p.slice_ms), lasts={"_known": present("price", 0.0)})
    return rows.filter(F.col("_known").isNotNull()).drop("_known")


def _slice_summary(known: DataFrame) -> DataFrame:
    """What one slice of an asset leaves behind, one row per ``(asset, slice)``.

    First and last price, number of changes between them, newest market, bid and
    ask. Null prices, bids, asks and markets are absent ones.
    """
    local = Window.partitionBy(_KEY, SLICE).orderBy("recv_ts", "ord")
    upto, prior = local.rowsBetween(_FIRST, 0), local.rowsBetween(_FIRST, -1)
    newest = [c for c in ("market_id", "best_bid", "best_ask") if c in known.columns]
    rows = known.select(
        _KEY, SLICE, "recv_ts", "ord",
        *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in newest],
        F.first("price", ignorenulls=True).over(upto).alias("_first"),
        F.last("price", ignorenulls=True).over(upto).alias("_last"),
        (F.last("price", ignorenulls=True).over(prior) != F.col("price")).alias("_moved"),
    )
    moves = F.sum(F.coalesce(F.col("_moved").cast("bigint"), F.lit(0))).over(upto)
    return rows.select(
        _KEY, SLICE, *newest, "_first", "_last", moves.alias("_moves"),
        F.lead("recv_ts").over(local).alias("_later"),
    ).filter(F.col("_later").isNull()).drop("_later")


def price_changes(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Events whose price differs from the asset's previous one, with ``seq``."""
    axis = Axis(width=p.slice_ms)
    priced = axis.cut(usable_price(events))
    slices = Window.partitionBy(_KEY).orderBy(SLICE)
    earlier = slices.rowsBetween(_FIRST, -1)
    carry = (
        _slice_summary(priced.select(_KEY, SLICE, "recv_ts", "ord", "price"))
        .withColumn("_before", F.last("_last", ignorenulls=True).over(earlier))
        .withColumn(
            "_total",
            F.col("_moves")
            + F.when(F.col("_before").isNull() | (F.col("_before") != F.col("_first")), 1).otherwise(0),
        )
        .select(
            _KEY, SLICE, "_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_seq0")
        )
    )
    local = Window.partitionBy(_KEY, SLICE).orderBy("recv_ts", "ord")
    rows = (
        priced.withColumn("_lag", F.lag("price").over(local))
        .join(carry, [_KEY, SLICE], "left")
        .withColumn("_prev", F.coalesce("_lag", "_before"))
        .withColumn(
            "_moved", (F.col("_prev").isNull() | (F.col("_prev") != F.col("price"))).cast("bigint")
        )
        .withColumn(
            "seq", F.col("_seq0") + F.sum("_moved").over(local.rowsBetween(_FIRST, 0))
        )
    )
    return rows.filter(F.col("_moved") == 1).select(*events.columns, "seq")


def samples(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Retained price samples of every asset: at most one per ``gap_ms``."""
    return sample_min_gap(
        usable_price(events).select(
            _KEY, F.col("recv_ts").cast("bigint").alias("recv_ts"),
            F.col("ord").cast("bigint").alias("ord"), "price",
        ),
        p.gap_ms, payload=("price",), width=p.slice_ms,
    )


def retain_last_n(
    df: DataFrame, n: int = 900, *, key: tuple[str, ...] = (_KEY,),
    order: tuple[str, ...] = ("recv_ts", "ord"),
) -> DataFrame:
    """Newest ``n`` rows per key. Map tasks already drop all but ``n`` per key
    (rank pushdown, up to ``spark.sql.optimizer.windowGroupLimitThreshold``)."""
    newest = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def _seeds(
    known: DataFrame, kept: DataFrame, halo: int, reach: int, p: Params,
    wanted: DataFrame | None, initial: DataFrame | None,
) -> DataFrame:
    """One row per ``(asset, slice)``: the state before the slice's first row.

    The halo of a slice are the samples at most ``reach`` before it; they lie in
    the ``halo`` slices before. The seed carries the newest sample older than that.
    """
    point = F.struct("recv_ts", "ord", "price")
    early = F.col("recv_ts") < (F.col(SLICE) + halo) * p.slice_ms - reach
    summary = _slice_summary(known).join(
        kept.groupBy(_KEY, SLICE).agg(
            F.max_by(point, "recv_ts").alias("_sample"),
            F.max_by(point, F.when(early, F.col("recv_ts"))).alias("_early"),
        ),
        [_KEY, SLICE], "left",
    )
    if wanted is not None:
        summary = (
            summary.withColumn("_w", F.lit(False))
            .unionByName(wanted.withColumn("_w", F.lit(True)), allowMissingColumns=True)
        )
        fields = [c for c in summary.columns if c not in (_KEY, SLICE, "_w")]
        summary = summary.groupBy(_KEY, SLICE).agg(
            *[F.max_by(c, F.when(~F.col("_w"), F.lit(1))).alias(c) for c in fields]
        )
    if initial is not None:
        start = initial.select(
            F.col("a").alias(_KEY), F.col("p").alias("_ip"), F.col("b").alias("_ib"),
            F.col("k").alias("_ik"), F.col("m").alias("_im"), F.col("seq").alias("_iseq"),
        )
        summary = summary.join(start, _KEY, "left")
    else:
        summary = summary.withColumns({
            "_ip": F.lit(None).cast("double"), "_ib": F.lit(None).cast("double"),
            "_ik": F.lit(None).cast("double"), "_im": F.lit(None).cast("string"),
            "_iseq": F.lit(None).cast("bigint"),
        })
    slices = Window.partitionBy(_KEY).orderBy(SLICE)
    earlier = slices.rowsBetween(_FIRST, -1)
    older = slices.rangeBetween(_FIRST, -(halo + 1))

    def state(column: str, start: str, absent: object) -> Column:
        return F.coalesce(
            F.last(column, ignorenulls=True).over(earlier), present(start, absent)
        )

    summary = summary.select(
        _KEY, SLICE, "_first", "_moves", "_iseq",
        state("_last", "_ip", 0.0).alias("price"),
        state("best_bid", "_ib", 0.0).alias("best_bid"),
        state("best_ask", "_ik", 0.0).alias("best_ask"),
        state("market_id", "_im", "").alias("market_id"),
        F.coalesce(
            F.last("_early", ignorenulls=True).over(slices.rangeBetween(-halo, -halo)),
            F.last("_sample", ignorenulls=True).over(older),
        ).alias("_old"),
    )
    opened = F.col("_first").isNotNull() & (
        F.col("price").isNull() | (F.col("price") != F.col("_first"))
    )
    total = F.coalesce("_moves", F.lit(0)) + F.when(opened, 1).otherwise(0)
    return summary.select(
        _KEY, SLICE, "price", "best_bid", "best_ask", "market_id",
        (F.coalesce(F.sum(total).over(earlier), F.lit(0)) + F.coalesce("_iseq", F.lit(0))).alias("_seq0"),
        F.coalesce("_old.recv_ts", (F.col(SLICE) - (halo + 1)) * F.lit(p.slice_ms)).alias("recv_ts"),
        F.col("_old.price").alias("s_price"),
        F.lit(_SEED).alias("_row"),
    )


def _grid(known: DataFrame, start: int, end: int, step: int, p: Params) -> tuple[DataFrame, DataFrame]:
    """``(asset, slice)`` pairs and instants of the grid, from each asset's first price."""
    born = known.filter(F.col("price").isNotNull()).groupBy(_KEY).agg(F.min("recv_ts").alias("_born"))
    lo = F.greatest(slice_expr("_born", p.slice_ms), slice_expr(F.lit(start), p.slice_ms))
    hi = slice_expr(F.lit(end), p.slice_ms)
    wanted = born.filter((lo <= hi) & (F.col("_born") <= end)).select(
        _KEY, "_born", F.explode(F.sequence(lo, hi)).alias(SLICE)
    )
    base, step_col = F.lit(start).cast("bigint"), F.lit(step).cast("bigint")
    open_at = F.greatest(F.col(SLICE) * p.slice_ms, F.col("_born"), base)
    behind = open_at - base
    first = base + F.call_function("div", behind + (step - 1), step_col) * step_col
    last = F.least((F.col(SLICE) + 1) * p.slice_ms - 1, F.lit(end).cast("bigint"))
    instants = wanted.filter(first <= last).select(
        _KEY, SLICE, F.explode(F.sequence(first, last, step_col)).alias("recv_ts"),
        F.lit(_GRID).alias("_row"), F.lit((1 << 63) - 1).alias("ord"),
    )
    return wanted.select(_KEY, SLICE), instants


_UNIT = 1e15  # log returns are summed as integers of this many units per 1
_COARSE = 1e9  # squares in two parts: units of 1e-9, and of 1e-24 for the rest


def _with_sums(points: DataFrame) -> DataFrame:
    """Samples of a slice with running sums of their log returns.

    ``s_n`` numbers the samples; ``q_c, q_s, q_a, q_b`` are count, sum and the two
    parts of the sum of squares of the returns so far, ``x_*`` the same at the next
    sample. All are integers, so that differences of running sums are exact.
    """
    line = Window.partitionBy(_KEY, SLICE).orderBy("recv_ts", F.col("ord").asc_nulls_first())
    upto, prior = line.rowsBetween(_FIRST, 0), line.rowsBetween(_FIRST, -1)
    price, old = F.col("s_price"), F.col("_old")
    points = points.withColumn("_old", F.last("s_price", ignorenulls=True).over(prior))
    points = points.withColumn("_ret", F.when((price > 0) & (old > 0), F.ln(price / old)))
    square = F.col("_ret") * F.col("_ret") * _COARSE
    points = points.withColumns({"_a": F.floor(square), "_b": F.round((square - F.floor(square)) * _UNIT)})
    parts = {
        "q_c": F.col("_ret").isNotNull().cast("bigint"),
        "q_s": F.round(F.col("_ret") * _UNIT).cast("bigint"),
        "q_a": F.col("_a").cast("bigint"), "q_b": F.col("_b").cast("bigint"),
    }
    points = points.withColumns({
        "s_n": F.when(price.isNotNull(), F.count("s_price").over(upto)),
        **{
            n: F.when(price.isNotNull(), F.coalesce(F.sum(v).over(upto), F.lit(0)))
            for n, v in parts.items()
        },
    })
    # Samples follow the seed row without holes, so the next row is the next sample.
    points = points.withColumns({f"x{n[1:]}": F.lead(n).over(line) for n in parts})
    return points.drop("_old", "_ret", "_a", "_b")


def state_rows(
    events: DataFrame,
    p: Params = Params(),
    *,
    marks: DataFrame | None = None,
    grid: tuple[int, int, int] | None = None,
    initial: DataFrame | None = None,
    with_hour: bool = False,
) -> DataFrame:
    """The state and statistics of the asset at every event (or grid instant).

    ``marks``    ``asset_id, recv_ts, ord`` of events to flag as ``marked``
    ``grid``     ``(start, end, step)``: also return the state at these instants
    ``initial``  snapshot rows (tick layout) the state starts from
    """
    looks = {"short": p.short_ms, "long": p.long_ms, "surge": p.surge_ms}
    if with_hour:
        looks["hour"] = p.hour_ms
    reach = max(*looks.values(), p.vol_ms + 1)
    halo = -(-reach // p.slice_ms)

    axis = Axis(width=p.slice_ms)
    known = axis.cut(_known(events))
    # Used twice below: one exchange, and no filter that only one use would add.
    kept = axis.cut(samples(events, p)).filter(
        F.col(_KEY).isNotNull() & F.col(SLICE).isNotNull()
    ).repartition(_KEY, SLICE)
    wanted, instants = _grid(known, *grid, p) if grid else (None, None)

    seeds = _seeds(known, kept, halo, reach, p, wanted, initial)
    reached = slice_expr(F.col("recv_ts") + reach, p.slice_ms)
    halos = kept.select(
        _KEY, F.explode(F.sequence(F.col(SLICE), reached)).alias(SLICE),
        "recv_ts", "ord", F.col("price").alias("s_price"), F.lit(_SAMPLE).alias("_row"),
    )
    rows = _with_sums(seeds.unionByName(halos, allowMissingColumns=True))
    pieces = [known.withColumn("_row", F.lit(_EVENT))]
    if marks is not None:
        pieces.append(axis.cut(marks.select(_KEY, "recv_ts", "ord")).withColumn("_row", F.lit(_MARK)))
    if instants is not None:
        pieces.append(instants)
    for piece in pieces:
        rows = rows.unionByName(piece, allowMissingColumns=True)

    line = Window.partitionBy(_KEY, SLICE).orderBy("recv_ts", F.col("ord").asc_nulls_first(), "_row")
    upto, prior = line.rowsBetween(_FIRST, 0), line.rowsBetween(_FIRST, -1)
    now = ("s_n", "q_c", "q_s", "q_a", "q_b")
    rows = rows.select(
        _KEY, SLICE, "recv_ts", "ord", "_row", "price", "_seq0", "s_price", "s_n",
        "x_c", "x_s", "x_a", "x_b",
        *[
            F.last(c, ignorenulls=True).over(upto).alias(c)
            for c in ("market_id", "best_bid", "best_ask")
        ],
        F.last("price", ignorenulls=True).over(upto).alias("last"),
        F.last("price", ignorenulls=True).over(prior).alias("_before"),
        *[F.coalesce(F.last(c, ignorenulls=True).over(upto), F.lit(0)).alias(f"now_{c}") for c in now],
        (F.lag("_row").over(line) == _MARK).alias("marked"),
    ).withColumn(
        "changed",
        (F.col("_row") == _EVENT) & F.col("price").isNotNull()
        & (F.col("_before").isNull() | (F.col("_before") != F.col("price"))),
    )
    zero = F.lit(0)
    steps = F.coalesce("_seq0", zero) + F.col("changed").cast("bigint")
    by_time = Window.partitionBy(_KEY, SLICE).orderBy("recv_ts")

    def asof(value: str, back: int, name: str) -> Column:
        frame = by_time.rangeBetween(_FIRST, -back)
        return F.last(value, ignorenulls=True).over(frame).alias(name)

    edge = ("s_n", "x_c", "x_s", "x_a", "x_b")
    rows = rows.withColumn("seq", F.sum(steps).over(upto)).select(
        _KEY, "recv_ts", "ord", "_row", "market_id", "best_bid", "best_ask", "last", "marked",
        "changed", "seq", *[f"now_{c}" for c in now],
        *[asof("s_price", back, f"at_{name}") for name, back in looks.items()],
        *[asof("s_n", back, f"n_{name}") for name, back in looks.items()],
        *[asof(c, p.vol_ms + 1, f"edge_{c}") for c in edge],
    ).filter(F.col("_row") >= _EVENT)

    def found(name: str) -> Column:
        return F.coalesce(F.col("now_s_n") - F.col(f"n_{name}") < p.ring, F.lit(False))

    def change(name: str) -> Column:
        move = (F.col("last") - F.col(f"at_{name}")) * 100
        return F.when(found(name), move).otherwise(F.lit(0.0))

    def within(part: str) -> Column:
        return F.col(f"now_q_{part}") - F.coalesce(f"edge_x_{part}", zero)

    inside = F.col("now_s_n") - F.coalesce("edge_s_n", zero)
    returns, total = within("c"), within("s") / _UNIT
    squares = within("a") / _COARSE + within("b") / (_COARSE * _UNIT)
    ok_vol = (inside >= 3) & (returns >= 2)
    spread = F.greatest(squares - total * total / F.greatest(returns, F.lit(1)), F.lit(0.0))
    vol = F.when(ok_vol, F.sqrt(spread / F.greatest(returns - 1, F.lit(1)))).otherwise(F.lit(0.0))
    hour = [change("hour").alias("c1h"), found("hour").alias("ok_1h")] if with_hour else []
    return rows.select(
        _KEY, "recv_ts", "ord", (F.col("_row") == _GRID).alias("on_grid"), "market_id", "last",
        "best_bid", "best_ask", "seq", "changed", F.coalesce("marked", F.lit(False)).alias("marked"),
        change("short").alias("c1m"), found("short").alias("ok_1m"),
        change("long").alias("c5m"), found("long").alias("ok_5m"), *hour,
        vol.alias("vol"), F.coalesce(ok_vol, F.lit(False)).alias("ok_vol"),
        F.when(found("surge"), F.col("at_surge")).alias("surge_from"),
    )


def as_ticks(rows: DataFrame) -> DataFrame:
    """State rows in the tick layout; ``ord`` is kept as the tie-break."""
    return rows.select(
        F.lit(RECORD_VERSION).alias("v"), F.col(_KEY).alias("a"),
        F.coalesce("market_id", F.lit("")).alias("m"), F.col("last").alias("p"),
        F.coalesce("best_bid", F.lit(0.0)).alias("b"), F.coalesce("best_ask", F.lit(0.0)).alias("k"),
        "c1m", "c5m", "vol", "seq", F.col("recv_ts").alias("rts"), F.col("recv_ts").alias("pts"),
        "ord", "ok_1m", "ok_5m", "ok_vol",
    )


def fit_slices(events: DataFrame, p: Params = Params(), most: int = 2_000_000) -> Params:
    """``p`` with the widest slices of which none exceeds ``most`` rows of an asset.

    Rows are counted once per asset and 1/64 slice; coarser counts are made of those,
    finer ones (down to a millisecond) are counted anew while a slice is too large. No
    slice takes more than half a task's share of all rows either, so that few assets
    still keep all tasks busy. Results do not depend on the width.
    """
    def counted(width: int) -> DataFrame:
        return durable(events.groupBy(_KEY, slice_expr("recv_ts", width).alias("_c")).agg(
            F.count(F.lit(1)).alias("_n")))

    def facts(counts: DataFrame) -> tuple[int, int, int]:
        row = counts.agg(
            F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0)),
            F.coalesce(F.max("_c") - F.min("_c"), F.lit(0)),
        ).first()
        return row[0], row[1], row[2]

    width = max(p.slice_ms // 64, 1)
    counts = counted(width)
    largest, total, span = facts(counts)
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(most, max(total // (2 * tasks), 20_000))
    while largest > most and width > 1:
        width = max(width // 64, 1)
        counts = counted(width)
        largest, _, span = facts(counts)
    while span > 0:
        counts = durable(counts.groupBy(
            _KEY, F.call_function("div", F.col("_c") - F.pmod("_c", F.lit(4)), F.lit(4).cast("bigint")).alias("_c")
        ).agg(F.sum("_n").alias("_n")))
        largest, _, span = facts(counts)
        if largest > most:
            break
        width *= 4
    return replace(p, slice_ms=width)


def build_ticks(events: DataFrame, p: Params = Params(), initial: DataFrame | None = None) -> DataFrame:
    """One tick per price change."""
    return as_ticks(state_rows(events, p, initial=initial).filter("changed"))


def chg_window(events: DataFrame, p: Params = Params(), with_hour: bool = True) -> DataFrame:
    """Price changes in percentage points over the look-backs, with ok flags."""
    hour = ["c1h", "ok_1h"] if with_hour else []
    return state_rows(events, p, with_hour=with_hour).select(
        _KEY, "recv_ts", "ord", "last", "c1m", "ok_1m", "c5m", "ok_5m", *hour
    )


def volatility(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Sample deviation of the log returns between retained samples of the window."""
    return state_rows(events, p).select(_KEY, "recv_ts", "ord", "last", "vol", "ok_vol")


def asof_lookup(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Newest retained sample at or before ``recv_ts - surge_ms`` (null: none)."""
    return state_rows(events, p).select(_KEY, "recv_ts", "ord", "last", "surge_from")


def surge_candidates(rows: DataFrame, p: Params) -> DataFrame:
    move = (F.col("last") - F.col("surge_from")) * 100
    return rows.filter(F.col("changed") & (F.abs(move) >= p.threshold)).select(
        _KEY, "recv_ts", "ord", F.coalesce("market_id", F.lit("")).alias("market_id"),
        F.col("surge_from").alias("from"), F.col("last").alias("to"),
    )


def detect_surges(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Moves of at least the threshold, at most one per asset and cooldown."""
    return sample_min_gap(
        surge_candidates(state_rows(events, p), p), p.cooldown_ms,
        payload=("market_id", "from", "to"),
    )


def snapshot_marks(events: DataFrame, p: Params = Params()) -> DataFrame:
    """Events at which a snapshot is due."""
    narrow = events.select(_KEY, "recv_ts", "ord", "price")
    return sample_min_gap(has_price(narrow, p), p.snapshot_ms)


def throttled_snapshots(
    events: DataFrame, p: Params = Params(), initial: DataFrame | None = None
) -> DataFrame:
    """The asset's state, at most once per ``snapshot_ms``, from its first price on."""
    rows = state_rows(events, p, marks=snapshot_marks(events, p), initial=initial)
    return as_ticks(rows.filter("marked"))


def restore_state(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per asset with the largest ``seq`` seen: an initial state."""
    newest = latest_per_key(snapshots, ("a",), ("pts", "seq"))
    top = snapshots.groupBy("a").agg(F.max("seq").alias("_seq"))
    return newest.join(top, "a").withColumn("seq", F.col("_seq")).drop("_seq")


def rank_movers(movers: DataFrame, n: int, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Top ``n`` by ``|c5m|`` (all when ``n <= 0``), ties by asset id, with ``rank``."""
    order = [F.abs("c5m").desc(), F.col("a").asc()]
    if not by and n <= 0:
        return global_rank(movers, order, "rank")
    if not by:
        # Partial top-n per task first, then one ranking of at most n rows.
        movers = movers.orderBy(*order).limit(n)
    ranked = movers.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n) if n > 0 else ranked


def movers_at(events: DataFrame, at: int, p: Params = Params()) -> DataFrame:
    """Change over ``long_ms`` of every asset with that much history, at one instant."""
    past = usable_price(events).filter(F.col("recv_ts") <= at)
    last = past.groupBy(_KEY).agg(F.max_by("price", F.struct("recv_ts", "ord")).alias("last"))
    kept = samples(past, p)
    old = F.col("recv_ts") <= at - p.long_ms
    hits = kept.groupBy(_KEY).agg(
        F.max_by("price", F.when(old, F.col("recv_ts"))).alias("_then"),
        F.count_if(~old).alias("_since"),
        F.count_if(old).alias("_old"),
    )
    return last.join(hits.filter((F.col("_old") > 0) & (F.col("_since") < p.ring)), _KEY).select(
        F.col(_KEY).alias("a"), ((F.col("last") - F.col("_then")) * 100).alias("c5m")
    )


def top_movers(events: DataFrame, at: int, p: Params = Params(), n: int | None = None) -> DataFrame:
    return rank_movers(movers_at(events, at, p), p.top if n is None else n)


def top_movers_on_grid(
    events: DataFrame, start: int, end: int, every: int, p: Params = Params(), n: int | None = None
) -> DataFrame:
    """The top list at every instant ``start, start + every, ... <= end``."""
    rows = state_rows(events, p, grid=(start, end, every)).filter("on_grid and ok_5m")
    movers = rows.select(F.col("recv_ts").alias("ts"), F.col(_KEY).alias("a"), "c5m")
    return rank_movers(movers, p.top if n is None else n, by=("ts",))


def top_lists(ranked: DataFrame) -> DataFrame:
    """Ranked movers as one record per instant (``n`` entries at most)."""
    entry = F.struct("rank", "a", "c5m")
    return ranked.groupBy("ts").agg(F.array_sort(F.collect_list(entry)).alias("_d")).select(
        F.lit(RECORD_VERSION).alias("v"), "ts",
        F.transform("_d", lambda e: F.struct(e["a"].alias("a"), e["c5m"].alias("c5m"))).alias("d"),
    )


def movers_from_ticks(ticks: DataFrame, n: int = 50) -> DataFrame:
    """Top list from the newest tick of each asset; no history needed."""
    newest = latest_per_key(ticks, ("a",), ("pts", "seq"))
    return rank_movers(newest.select("a", "c5m"), n)


def chart_series(ticks: DataFrame, n: int = 900, bucket_ms: int = 1_000) -> DataFrame:
    """Last price per asset and second, newest ``n`` seconds."""
    second = slice_expr("pts", bucket_ms).alias("t")
    points = ticks.groupBy("a", second).agg(F.max_by("p", F.struct("pts", "seq")).alias("p"))
    return retain_last_n(points, n, key=("a",), order=("t",))
