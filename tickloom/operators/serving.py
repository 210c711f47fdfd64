"""Subscriptions, fan-out and conflation.

A subscription operation is ``client_id, ts, ord, op, ch, ids`` with ``op`` one of
``sub``, ``unsub``, ``close``; a client id stands for one connection.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.wire import envelope, envelope_one
from tickloom.operators.axis import SLICE, Axis, running, slice_expr
from tickloom.operators.gap import sample_min_gap
from tickloom.operators.joins import asof_join, skew_join
from tickloom.session import durable

_CLIENT = ("client_id",)
_KEY = ("client_id", "ch", "id")
FAR = (1 << 62)  # end of a subscription that is still open


def op_keys(ops: DataFrame) -> DataFrame:
    """One row per requested key: an asset id, or ``''`` for whole channels."""
    ids = F.when(F.col("ch") == "asset", F.coalesce("ids", F.array().cast("array<string>"))).otherwise(
        F.array(F.lit(""))
    )
    return ops.withColumn("_ids", ids).select(
        *[c for c in ops.columns if c != "ids"], F.posexplode("_ids").alias("pos", "id")
    )


def subscription_intervals(ops: DataFrame, width: int = 900_000) -> DataFrame:
    """When each key was subscribed: ``client_id, ch, id, start, start_ord, end, end_ord``.

    For logs without a cap. A repeated ``sub`` changes nothing, an ``unsub`` or the
    client's ``close`` ends the interval (``FAR`` while open).
    """
    at = F.struct(F.col("ts").alias("t"), F.col("ord").alias("o"))
    axis = Axis(_CLIENT, ("ts", "ord"), width)
    timed = running(ops, axis, after={"_close": F.when(F.col("op") == "close", at)})
    keys = op_keys(timed.filter(F.col("op").isin("sub", "unsub")))
    rows = running(
        keys, Axis(_KEY, ("ts", "ord", "pos"), width),
        before={"_was": F.struct("op", F.col("_close").alias("close"))},
        after={"_off": F.when(F.col("op") == "unsub", at)},
    )
    was_on = (F.col("_was.op") == "sub") & (
        F.col("_was.close").isNull() | (F.col("_was.close") > at)
    )
    starts = rows.filter((F.col("op") == "sub") & ~F.coalesce(was_on, F.lit(False)))
    far = F.struct(F.lit(FAR).alias("t"), F.lit(FAR).alias("o"))
    end = F.least(F.coalesce("_off", far), F.coalesce("_close", far))
    return starts.select(
        *_KEY, F.col("ts").alias("start"), F.col("ord").alias("start_ord"),
        end["t"].alias("end"), end["o"].alias("end_ord"),
    )


def effective_ops(intervals: DataFrame) -> DataFrame:
    """Intervals as signed steps: ``client_id, ch, id, ts, ord, step``."""
    opened = intervals.select(*_KEY, F.col("start").alias("ts"), F.col("start_ord").alias("ord"), F.lit(1).alias("step"))
    closed = intervals.filter(F.col("end") < FAR).select(
        *_KEY, F.col("end").alias("ts"), F.col("end_ord").alias("ord"), F.lit(-1).alias("step")
    )
    return opened.unionByName(closed)


def _fold_ops(cap: int):
    """Ordered fold per connection; the state is the set of subscribed keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, held = None, set()
        for pdf in batches:
            out: list[tuple] = []
            for client, life, ts, ord_, op, ch, ids in zip(
                pdf["client_id"], pdf["_life"], pdf["ts"], pdf["ord"], pdf["op"], pdf["ch"], pdf["ids"]
            ):
                if (client, life) != owner:
                    owner, held = (client, life), set()
                if op == "close":
                    out += [(client, ts, ord_, k[0], k[1], -1, None) for k in sorted(held)]
                    held = set()
                    continue
                asked = [("asset", i) for i in (ids if ids is not None else ())] if ch == "asset" else [(ch, "")]
                if op == "unsub":
                    for key in asked:
                        if key in held:
                            held.remove(key)
                            out.append((client, ts, ord_, key[0], key[1], -1, None))
                elif op == "sub":
                    # a new id named twice in one request counts twice
                    if cap > 0 and len(held) + sum(k not in held for k in asked) > cap:
                        out.append((client, ts, ord_, ch, None, 0, "too_many_subs"))
                        continue
                    for key in asked:
                        if key not in held:
                            held.add(key)
                            out.append((client, ts, ord_, key[0], key[1], 1, None))
            yield pd.DataFrame(out, columns=["client_id", "ts", "ord", "ch", "id", "step", "error"])

    return run


def apply_subscription_ops(ops: DataFrame, cap: int = 500, width: int = 900_000) -> DataFrame:
    """Effective steps of a subscription log under a per-client cap.

    A request that would exceed the cap is rejected whole and appears as a row
    with ``error = 'too_many_subs'`` and ``step = 0``. What is accepted depends on
    all earlier operations of the connection, so the capped log is folded in order,
    row by row, holding at most ``cap`` keys; connections (the stretches between
    ``close`` operations) are folded in parallel. ``cap <= 0`` needs no fold.
    """
    columns = [*_KEY, "ts", "ord", "step"]
    if cap <= 0:
        return effective_ops(subscription_intervals(ops, width)).select(
            *columns, F.lit(None).cast("string").alias("error")
        )
    lives = running(
        ops, Axis(_CLIENT, ("ts", "ord"), width),
        sums={"_closes": F.when(F.col("op") == "close", 1).otherwise(0)},
    ).withColumn("_life", F.col("_closes") - F.when(F.col("op") == "close", 1).otherwise(0))
    kind = dict(ops.dtypes)["client_id"]
    return (
        lives.select("client_id", "_life", "ts", "ord", "op", "ch", "ids")
        .repartition("client_id", "_life")
        .sortWithinPartitions("client_id", "_life", "ts", "ord")
        .mapInPandas(
            _fold_ops(cap),
            f"client_id {kind}, ts bigint, ord bigint, ch string, id string, step int, error string",
        )
        .select(*columns, "error")
    )


def subscription_counts(steps: DataFrame, width: int = 900_000) -> DataFrame:
    """Live subscriptions and subscribed clients after each instant with a change."""
    per_client = running(
        steps.groupBy("client_id", "ts").agg(F.sum("step").alias("_d")),
        Axis(_CLIENT, ("ts",), width), sums={"_live": F.col("_d")},
    )
    before = F.col("_live") - F.col("_d")
    joined = F.when((before == 0) & (F.col("_live") > 0), 1).when(
        (before > 0) & (F.col("_live") == 0), -1
    ).otherwise(0)
    totals = per_client.groupBy("ts").agg(F.sum("_d").alias("_d"), F.sum(joined).alias("_c"))
    return running(
        totals, Axis((), ("ts",), width), sums={"subscriptions": F.col("_d"), "clients": F.col("_c")}
    ).select("ts", "subscriptions", "clients")


def live_counts_at(intervals: DataFrame, at: int, by: tuple[str, ...]) -> DataFrame:
    """Subscriptions live at one instant, per client or per key."""
    live = intervals.filter((F.col("start") <= at) & (F.col("end") > at))
    return live.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def subscribed_only(
    ticks: DataFrame, intervals: DataFrame, key: str = "a", *, ts: str = "ts", order: str = "ord", width: int = 900_000
) -> DataFrame:
    """Ticks of assets somebody is subscribed to at the tick's time.

    Intervals open and close a running count per asset; a tick passes while the count
    is above zero. Ticks and intervals are never paired.
    """
    wanted = intervals.filter(F.col("ch") == "asset")

    def step(at: str, by: int, rows: DataFrame) -> DataFrame:
        return rows.select(
            F.col("id").alias("_k"), F.col(at).alias("_t"), F.col(f"{at}_ord").alias("_o"), F.lit(0).alias("_side"),
            F.lit(by).alias("_d"), F.lit(None).alias("_row"),
        )

    rows = ticks.select(
        F.col(key).alias("_k"), F.col(ts).cast("bigint").alias("_t"), F.col(order).cast("bigint").alias("_o"),
        F.lit(1).alias("_side"), F.lit(0).alias("_d"), F.struct(*ticks.columns).alias("_row"),
    )
    steps = step("start", 1, wanted).unionByName(step("end", -1, wanted.filter(F.col("end") < FAR)))
    counted = running(
        steps.unionByName(rows), Axis(("_k",), ("_t", "_o", "_side"), width), sums={"_live": F.col("_d")}
    )
    return counted.filter((F.col("_side") == 1) & (F.col("_live") > 0)).select("_row.*")


#: Each level of time buckets is so many times wider than the one below; 2 ** 43 ms are 278 years.
FACTOR, HORIZON = 16, 1 << 43


def _widths(bucket_ms: int) -> list[int]:
    widths = [bucket_ms]
    while widths[-1] < HORIZON:
        widths.append(widths[-1] * FACTOR)
    return widths


def _covered(start: Column, end: Column, widths: list[int]) -> Column:
    """Buckets ``(level, bucket)`` whose times hold the interval.

    A closed interval goes to the level whose buckets are just as wide as it is long, where
    it touches two at most. An open one is covered from its start on: at each level by the
    buckets that are left of the wider one around the start.
    """
    def at(n: int, buckets: Column) -> Column:
        return F.transform(buckets, lambda b: F.struct(F.lit(n).alias("level"), b.alias("bucket")))

    def span(low: Column, high: Column) -> Column:
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    closed = at(len(widths) - 1, span(slice_expr(start, widths[-1]), slice_expr(end, widths[-1])))
    for n in range(len(widths) - 2, -1, -1):
        here = at(n, span(slice_expr(start, widths[n]), slice_expr(end, widths[n])))
        closed = F.when(end - start <= widths[n], here).otherwise(closed)
    parts = [at(0, F.array(slice_expr(start, widths[0])))]
    for n, width in enumerate(widths):
        first = slice_expr(start, width) + 1
        last = (slice_expr(start, widths[n + 1]) + 1) * FACTOR - 1 if n + 1 < len(widths) else first
        parts.append(at(n, span(first, last)))
    return F.when(end < FAR, closed).otherwise(F.concat(*parts))


def fanout_pairs(
    messages: DataFrame, intervals: DataFrame, *, hot: DataFrame | None = None, bucket_ms: int | None = 60_000
) -> DataFrame:
    """Messages beside the intervals they are compared with: those of their key whose time
    buckets they fall into (all of their key without ``bucket_ms``)."""
    if bucket_ms is None:
        return skew_join(messages, intervals, ("ch", "id"), spread=("ts", "ord"), hot=hot)
    widths, end = _widths(bucket_ms), F.col("end")
    if not messages.isStreaming:
        intervals = durable(intervals)  # read for the levels and again for the join
        last = messages.agg(F.max("ts")).first()[0]
        if last is not None:
            # nothing is sent later: an open interval takes two buckets and not some of each level
            end = F.least(end, F.lit(last + 1))
    placed = intervals.withColumn("_at", F.explode(_covered(F.col("start"), end, widths)))
    placed = placed.select("*", "_at.level", "_at.bucket").drop("_at")
    # a handful of numbers: a message is copied only to the levels that hold an interval
    used = sorted(r[0] for r in placed.select("level").distinct().collect()) or [0]
    probes = F.array(*[
        F.struct(F.lit(n).alias("level"), slice_expr("ts", widths[n]).alias("bucket")) for n in used
    ])
    probing = messages.withColumn("_at", F.explode(probes)).select(*messages.columns, "_at.level", "_at.bucket")
    if hot is None:
        return skew_join(probing, placed, ("ch", "id", "level", "bucket"), spread=("ts", "ord")).drop("level", "bucket")
    spread = F.explode(F.array([F.struct(F.lit(n).alias("level")) for n in used]))
    levels = hot.withColumn("_l", spread).select(*hot.columns, "_l.level")
    buckets = placed.select("ch", "id", "level", "bucket").distinct().join(levels, ["ch", "id", "level"])
    return skew_join(
        probing, placed, ("ch", "id", "level", "bucket"), spread=("ts", "ord"), hot=buckets
    ).drop("level", "bucket")


def fanout_join(
    messages: DataFrame, intervals: DataFrame, *, hot: DataFrame | None = None, bucket_ms: int | None = 60_000
) -> DataFrame:
    """Each message to every client subscribed to its key at its time.

    ``messages``: ``ch, id, ts, ord, ...``. Intervals are entered in time buckets, long ones in
    wider buckets (``bucket_ms`` is the finest), so a message meets the subscriptions around
    its time and not a key's whole past. ``bucket_ms=None`` pairs by key alone, for keys with few
    intervals. ``hot`` (``ch, id, parts``) spreads the messages of busy keys further, see
    :func:`tickloom.operators.joins.hot_keys`. One row per delivery is what is asked for, so the
    output is as large as the traffic.
    """
    at = F.struct(F.col("ts").alias("t"), F.col("ord").alias("o"))
    start = F.struct(F.col("start").alias("t"), F.col("start_ord").alias("o"))
    end = F.struct(F.col("end").alias("t"), F.col("end_ord").alias("o"))
    met = fanout_pairs(messages, intervals, hot=hot, bucket_ms=bucket_ms)
    return met.filter((start <= at) & (at < end)).select("client_id", *messages.columns)


def _window(ts: str, flush_ms: int):
    width = max(flush_ms, 1)
    return slice_expr(ts, width) * F.lit(width)


def conflate(deliveries: DataFrame, flush_ms: int = 50, *, value: str = "value") -> DataFrame:
    """At most one ``ticks`` and one ``top`` message per client and flush window.

    Of each asset only the newest tick of the window is sent, of the top list only
    the newest version; alerts and sys messages pass one by one.
    """
    window = _window("ts", flush_ms).alias("flush")
    newest = F.max_by(value, F.struct("ts", "ord")).alias(value)
    conflated = deliveries.filter(F.col("ch").isin("asset", "top"))
    last = conflated.groupBy("client_id", window, "ch", "id").agg(newest)
    ticks = (
        last.filter(F.col("ch") == "asset")
        .groupBy("client_id", "flush")
        .agg(F.array_sort(F.collect_list(F.struct("id", value))).alias("_items"))
        .select(
            "client_id", "flush", F.lit("ticks").alias("t"), F.size("_items").alias("n"),
            envelope("ticks", F.transform("_items", lambda i: i[value])).alias("frame"),
        )
    )
    tops = last.filter(F.col("ch") == "top").select(
        "client_id", "flush", F.lit("top").alias("t"), F.lit(1).alias("n"),
        envelope_one("top", value).alias("frame"),
    )
    kind = F.when(F.col("ch") == "alerts", "alert").otherwise(F.col("ch"))
    single = deliveries.filter(F.col("ch").isin("alerts", "sys")).select(
        "client_id", window, kind.alias("t"), F.lit(1).alias("n"),
        envelope_one(kind, value).alias("frame"),
    )
    return ticks.unionByName(tops).unionByName(single)


def conflate_before_fanout(
    messages: DataFrame, intervals: DataFrame, flush_ms: int = 50, *, hot: DataFrame | None = None
) -> DataFrame:
    """Deliveries that survive conflation, without multiplying what it would drop.

    A subscription that covers a whole flush window needs only the newest message
    of the key in that window, so those are reduced before the join. Only windows
    in which a subscription starts or ends see the single messages.
    """
    window = _window("ts", flush_ms)
    width = max(flush_ms, 1)
    rest = [c for c in messages.columns if c not in ("ch", "id")]
    reduced = (
        messages.groupBy("ch", "id", window.alias("flush"))
        .agg(F.max_by(F.struct(*rest), F.struct("ts", "ord")).alias("_m"))
        .select("ch", "id", "_m.*")
    )
    inner_start = _window("start", flush_ms) + width
    inner_end = F.when(F.col("end") >= FAR, F.lit(FAR)).otherwise(_window("end", flush_ms))
    whole = intervals.withColumns({
        "start": inner_start, "start_ord": F.lit(-FAR), "end": inner_end, "end_ord": F.lit(-FAR),
    }).filter(F.col("start") < F.col("end"))
    full = fanout_join(reduced, whole, hot=hot, bucket_ms=None)
    # the partial windows at either end of each interval
    first_end = F.least("end", inner_start)
    head = intervals.select(
        *_KEY, "start", "start_ord", first_end.alias("end"),
        F.when(first_end == F.col("end"), F.col("end_ord")).otherwise(F.lit(-FAR)).alias("end_ord"),
    )
    tail = intervals.filter((F.col("end") < FAR) & (_window("end", flush_ms) >= inner_start)).select(
        *_KEY, _window("end", flush_ms).alias("start"), F.lit(-FAR).alias("start_ord"), "end", "end_ord"
    )
    partial = head.unionByName(tail)
    edges = partial.select("ch", "id", _window("start", flush_ms).alias("flush")).distinct()
    single = messages.withColumn("flush", window).join(edges, ["ch", "id", "flush"], "left_semi").drop("flush")
    return full.unionByName(fanout_join(single, partial, hot=hot, bucket_ms=None))


def flash_keys(ticks: DataFrame, batch_ms: int) -> DataFrame:
    """Asset ids touched in each batch window (one row per id)."""
    return ticks.select(_window("pts", batch_ms).alias("batch"), "a").distinct()


def snapshot_on_subscribe(
    ops: DataFrame, ticks: DataFrame, tops: DataFrame | None = None, *, value: str = "value",
    width: int = 900_000, steps: DataFrame | None = None,
) -> DataFrame:
    """Reply to accepted ``sub`` requests with the state known at that moment.

    ``steps`` is the capped log (:func:`apply_subscription_ops`): requests it rejects
    get an error (:func:`rejections`) and no snapshot.

    Asset requests get one ``snap`` message with the newest tick of every requested
    id that has one (also of ids already subscribed); top requests get the newest
    list; requests for nothing known get no message. ``ticks``: ``id, ts, ord, value``.
    """
    subs = ops.filter(F.col("op") == "sub").select("client_id", "ts", "ord", "ch", "ids")
    if steps is not None:
        refused = steps.filter(F.col("error").isNotNull()).select("client_id", "ts", "ord").distinct()
        subs = subs.join(refused, ["client_id", "ts", "ord"], "left_anti")
    asked = op_keys(subs.filter(F.col("ch") == "asset"))
    known = asof_join(
        asked, ticks.select("id", "ts", "ord", value), ("id",), "ts", "ts",
        left_order=("ord",), right_order=("ord",), width=width,
    ).filter(F.col("hit").isNotNull())
    snaps = (
        known.groupBy("client_id", "ts", "ord")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.col(f"hit.{value}").alias("v")))).alias("_i"))
        .select(
            "client_id", "ts", "ord", F.lit("snap").alias("t"), F.size("_i").alias("n"),
            envelope("snap", F.transform("_i", lambda i: i["v"])).alias("frame"),
        )
    )
    if tops is None:
        return snaps
    wants = subs.filter(F.col("ch") == "top").drop("ids").withColumn("id", F.lit("top"))
    lists = asof_join(
        wants, tops.select(F.lit("top").alias("id"), "ts", "ord", value), ("id",), "ts", "ts",
        left_order=("ord",), right_order=("ord",), width=width,
    ).filter(F.col("hit").isNotNull())
    return snaps.unionByName(lists.select(
        "client_id", "ts", "ord", F.lit("top").alias("t"), F.lit(1).alias("n"),
        envelope_one("top", F.col(f"hit.{value}")).alias("frame"),
    ))


def rejections(steps: DataFrame, cap: int) -> DataFrame:
    """Error replies for rejected requests."""
    from tickloom.functions.wire import error

    return steps.filter(F.col("error").isNotNull()).select(
        "client_id", "ts", "ord", error(F.col("error"), F.lit(f"limit {cap}")).alias("frame")
    )


def consecutive_full_runs(cycles: DataFrame, run: int = 3, width: int = 10_000) -> DataFrame:
    """First flush cycle at which a client's queue was full ``run`` times in a row.

    ``cycles``: ``client_id, cycle, full``.
    """
    axis = Axis(_CLIENT, ("cycle",), width)
    counted = running(cycles, axis, sums={"_n": F.lit(1)})
    rows = running(counted, axis, lasts={"_clear": F.when(~F.col("full"), F.col("_n"))})
    length = F.col("_n") - F.coalesce("_clear", F.lit(0))
    return rows.filter(length >= run).groupBy("client_id").agg(F.min("cycle").alias("cycle"))


def rate_limit_violations(
    connects: DataFrame, messages: DataFrame, *, limit: int = 20, window_ms: int = 1_000,
    width: int = 900_000,
) -> DataFrame:
    """First message of each client beyond ``limit`` inside one counting window.

    A window opens at the connect and again at the first message at least
    ``window_ms`` after it opened; that message counts as one, the connect as none.
    ``connects``: ``client_id, ts``; ``messages``: ``client_id, ts, ord``.
    """
    rows = connects.select("client_id", "ts", F.lit(0).alias("_m"), F.lit(-1).cast("bigint").alias("ord"))
    rows = rows.unionByName(messages.select("client_id", "ts", F.lit(1).alias("_m"), "ord"))
    order = ("ts", "_m", "ord")
    opened = sample_min_gap(rows, window_ms, key=_CLIENT, order=order)
    flagged = rows.withColumn("_open", F.lit(0)).unionByName(opened.withColumn("_open", F.lit(-1)))
    placed = running(
        flagged, Axis(_CLIENT, ("ts", "_m", "ord", "_open"), width),
        lasts={"_from": F.when(F.col("_open") == -1, F.struct("ts", "_m", "ord"))},
    ).filter((F.col("_open") == 0) & (F.col("_m") == 1))
    # At most limit + 1 rows per window leave each map task.
    within = Window.partitionBy("client_id", "_from").orderBy("ts", "ord")
    late = placed.withColumn("_k", F.row_number().over(within)).filter(F.col("_k") == limit + 1)
    return late.groupBy("client_id").agg(F.min(F.struct("ts", "ord")).alias("_f")).select(
        "client_id", "_f.ts", "_f.ord"
    )
