"""The per-asset state machine as a Structured Streaming operator.

Same semantics as :func:`tickloom.operators.series.state_rows`, over the events of one asset in a
micro-batch at once: values are carried, looked up and summed in whole columns, and only the rows
that a minimum distance selects are visited one by one. State lives in the state store (one
value per asset, at most ``ring`` samples), survives restarts through the
checkpoint, and can start from snapshot rows. However much one asset brings into a
micro-batch, ``SORTED`` rows of it or so are worked on at once: more are sorted in runs in the
task's temporary folder first.
"""
from __future__ import annotations

import pickle
import sys
import tempfile
from collections.abc import Iterator
from typing import IO

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.params import Params
from tickloom.schemas import RECORD_VERSION

STATE = (
    "last double, bid double, ask double, market string, seq bigint, snapped bigint, fired bigint, "
    "ring_ts array<bigint>, ring_price array<double>, grid bigint, newest bigint, late bigint"
)
_FRESH = (0.0, 0.0, 0.0, "", 0, None, None, [], [], None, None, 0)
_WHOLE = ("seq", "snapped", "fired", "grid", "newest", "late")
OUTPUT = (
    "kind string, a string, m string, p double, b double, k double, c1m double, c5m double, vol double, "
    "seq bigint, rts bigint, ord bigint, ok_1m boolean, ok_5m boolean, ok_vol boolean, surge_from double"
)
_NAMES = [part.split()[0] for part in OUTPUT.split(", ")]
_STATE_NAMES = [part.split()[0] for part in STATE.split(", ")]
_TIME = ["recv_ts", "ord"]
_EVENT = [*_TIME, "price", "best_bid", "best_ask", "market_id"]
#: Rows of an asset sorted and worked on at once, and rows of a run read at once.
SORTED, PIECE = 100_000, 5_000


def _in_order(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(frames, ignore_index=True).sort_values(_TIME, kind="stable")


def _run(rows: pd.DataFrame) -> IO[bytes]:
    """Sorted rows in a file that goes with its handle."""
    file = tempfile.TemporaryFile()
    for at in range(0, len(rows), PIECE):
        pickle.dump(rows.iloc[at:at + PIECE], file)
    file.seek(0)
    return file


def _piece(file: IO[bytes]) -> pd.DataFrame | None:
    try:
        return pickle.load(file)
    except EOFError:
        return None


def in_time_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows in the order of ``recv_ts, ord``, in frames of ``SORTED`` rows or so."""
    held, size, runs = [], 0, []
    for frame in frames:
        held.append(frame[_EVENT])
        size += len(frame)
        if size >= SORTED:
            runs.append(_run(_in_order(held)))
            held, size = [], 0
    if not runs:
        if held:
            yield _in_order(held)
        return
    if held:
        runs.append(_run(_in_order(held)))
    heads, out, size = {f: _piece(f) for f in runs}, [], 0
    while heads:
        # no run has a row before the end of the piece that ends first but those at hand
        ends = {f: tuple(head[_TIME].iloc[-1].tolist()) for f, head in heads.items()}
        ts, ord_ = min(ends.values())
        taken = []
        for f, head in list(heads.items()):
            before = head["recv_ts"].to_numpy() < ts
            n = int((before | (head["recv_ts"].to_numpy() == ts) & (head["ord"].to_numpy() <= ord_)).sum())
            taken.append(head.iloc[:n])
            heads[f] = head.iloc[n:] if n < len(head) else _piece(f)
            if heads[f] is None:
                del heads[f]
                f.close()
        out.append(_in_order(taken))
        size += len(out[-1])
        if size >= SORTED or not heads:
            yield pd.concat(out, ignore_index=True)
            out, size = [], 0


def kept_apart(ts: np.ndarray, last: int | None, gap: int) -> np.ndarray:
    """Places in ascending ``ts`` taken greedily, at least ``gap`` after the one before (``last`` at
    first). Only the places taken are visited: where each leads to is looked up for all at once."""
    after = np.maximum(np.searchsorted(ts, ts + gap), np.arange(1, len(ts) + 1)).tolist()
    at = 0 if last is None else int(np.searchsorted(ts, last + gap))
    taken = []
    while at < len(ts):
        taken.append(at)
        at = after[at]
    return np.array(taken, np.int64)


def carried(values: np.ndarray, given: np.ndarray, before) -> np.ndarray:
    """Newest value that is ``given``, up to and including each row; ``before`` if there is none."""
    at = np.maximum.accumulate(np.where(given, np.arange(len(values)), -1))
    return np.where(at >= 0, values[at], before)


class Samples:
    """Retained samples of an asset, those of earlier micro-batches first, and look-backs of many
    rows at once. ``count`` is how many samples a row has behind it."""

    def __init__(self, times: np.ndarray, prices: np.ndarray, ring: int) -> None:
        self.times, self.prices, self.ring = times, prices, ring
        with np.errstate(all="ignore"):
            ratio = prices[1:] / prices[:-1]
            good = (prices[1:] > 0) & (prices[:-1] > 0)
            returns = np.where(good, np.log(np.where(good, ratio, 1.0)), 0.0).astype(np.longdouble)
        zero = np.zeros(2, np.longdouble)[:min(len(times), 1) + 1]
        # sums up to and including each sample, with nothing before the first
        self.number = np.concatenate([zero, np.cumsum(good)]).astype(np.int64)
        self.total = np.concatenate([zero, np.cumsum(returns)])
        self.squares = np.concatenate([zero, np.cumsum(returns * returns)])

    def asof(self, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Price of the newest sample not after ``at``, and whether the ring still holds it."""
        place = np.searchsorted(self.times, at, side="right") - 1
        held = (place >= 0) & (place >= count - self.ring)
        price = self.prices[np.maximum(place, 0)] if len(self.prices) else np.zeros(len(at))
        return np.where(held, price, np.nan), held

    def volatility(self, since: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Deviation of the returns between the samples from ``since`` on, and whether there are
        three samples and two returns."""
        first = np.maximum(np.searchsorted(self.times, since), count - self.ring)
        first = np.minimum(first, count)
        # the return into the first sample starts before the window
        low = np.minimum(first + 1, count)
        n = self.number[count] - self.number[low]
        total, squares = self.total[count] - self.total[low], self.squares[count] - self.squares[low]
        good = (count - first >= 3) & (n >= 2)
        n = np.maximum(n, 2)
        value = np.sqrt(np.maximum(squares - total * total / n, 0) / (n - 1)).astype(np.float64)
        return np.where(good, value, 0.0), good


class AssetProcessor(StatefulProcessor):
    """Emits tagged rows: ``tick`` on a price change, ``alert`` on a surge,
    ``snapshot`` at most once per ``snapshot_ms``, and with ``every`` a ``grid`` row: the
    change at each multiple of ``every`` milliseconds, once it is certain that no earlier
    event is to come (a later event of the asset is there, or the watermark has passed).
    With ``late_ms`` an event so much older than the newest of earlier micro-batches changes
    nothing and comes out as a ``late`` row, numbered per asset."""

    def __init__(self, p: Params, every: int | None = None, late_ms: int | None = None) -> None:
        self.p, self.every, self.late_ms = p, every, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("asset", STATE)

    def _load(self) -> dict:
        if self.state.exists():
            return dict(zip(_STATE_NAMES, self.state.get()))
        return dict(zip(_STATE_NAMES, _FRESH))

    def _save(self, s: dict) -> None:
        self.state.update(tuple(s[n] for n in _STATE_NAMES))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row, s = initialState.iloc[0], dict(zip(_STATE_NAMES, _FRESH))
        if "ring_ts" in initialState:  # another stream's whole state
            for n, fresh in zip(_STATE_NAMES, _FRESH):
                value = row[n]
                s[n] = list(value) if isinstance(fresh, list) else None if pd.isna(value) else type(value)(value)
                if n in _WHOLE and s[n] is not None:
                    s[n] = int(s[n])
        else:
            s |= {"last": float(row["p"]), "bid": float(row["b"]), "ask": float(row["k"]), "market": row["m"], "seq": int(row["seq"])}
        self._save(s)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = self._load()
        late = None if self.late_ms is None or s["newest"] is None else s["newest"] - self.late_ms
        for events in in_time_order(rows):
            yield from self._advance(key[0], events, s, late)
        if self.every and s["grid"] is not None:
            self.handle.registerTimer(s["grid"] + self.every)
        self._save(s)

    def _advance(self, asset: str, events: pd.DataFrame, s: dict, before: int | None) -> Iterator[pd.DataFrame]:
        """Results of the next events in order; ``s`` follows. Events ``before`` are late."""
        p, ts = self.p, events["recv_ts"].to_numpy(np.int64)
        if before is not None:
            late = ts < before
            if late.any():
                yield self._late(asset, events[late], s)
                events, ts = events[~late], ts[~late]
        if not len(ts):
            return
        s["newest"] = max(int(ts[-1]), s["newest"] if s["newest"] is not None else int(ts[-1]))
        ord_ = events["ord"].to_numpy(np.int64)
        price, bid, ask = (events[c].to_numpy(np.float64) for c in ("price", "best_bid", "best_ask"))
        names = events["market_id"].to_numpy(object)
        market, bid, ask = carried(names, names != "", s["market"]), carried(bid, bid != 0, s["bid"]), carried(ask, ask != 0, s["ask"])
        priced = price != 0
        last = carried(price, priced, s["last"])
        changed = priced & (price != np.concatenate([[s["last"]], last[:-1]]))
        seq = s["seq"] + np.cumsum(changed)

        where = np.flatnonzero(priced)
        new = where[kept_apart(ts[where], s["ring_ts"][-1] if len(s["ring_ts"]) else None, p.gap_ms)]
        old = len(s["ring_ts"])
        samples = Samples(
            np.concatenate([np.array(s["ring_ts"], np.int64), ts[new]]),
            np.concatenate([np.array(s["ring_price"], np.float64), price[new]]), p.ring,
        )
        count = old + np.searchsorted(new, np.arange(len(ts)), side="right")

        known = np.flatnonzero(last != 0)
        due = known[kept_apart(ts[known], s["snapped"], p.snapshot_ms)]
        ticks = np.flatnonzero(changed)
        surge, held = samples.asof(ts[ticks] - p.surge_ms, count[ticks])
        steep = ticks[held & (np.abs((last[ticks] - surge) * 100) >= p.threshold)]
        fired = steep[kept_apart(ts[steep], s["fired"], p.cooldown_ms)]
        yield self._rows(asset, [("tick", ticks), ("alert", fired), ("snapshot", due)],
                         (ts, ord_, market, last, bid, ask, seq, count), samples)
        if self.every:
            grid = s["grid"] if s["grid"] is not None else int(ts[0] - ts[0] % self.every)
            before = (s["market"], s["last"], s["bid"], s["ask"], s["seq"], old)
            now = (ts, market, last, bid, ask, seq, count)
            s["grid"], frame = self._grid(asset, grid, int(ts[-1]) - 1, before, now, samples)
            yield frame
        s |= {
            "last": float(last[-1]), "bid": float(bid[-1]), "ask": float(ask[-1]), "market": market[-1], "seq": int(seq[-1]),
            "ring_ts": samples.times[-p.ring:].tolist(), "ring_price": samples.prices[-p.ring:].tolist(),
        }
        if len(due):
            s["snapped"] = int(ts[due[-1]])
        if len(fired):
            s["fired"] = int(ts[fired[-1]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        samples = Samples(np.array(s["ring_ts"], np.int64), np.array(s["ring_price"], np.float64), self.p.ring)
        before = (s["market"], s["last"], s["bid"], s["ask"], s["seq"], len(s["ring_ts"]))
        none = np.array([], np.int64)
        reached, frame = self._grid(
            key[0], s["grid"], timerValues.getCurrentWatermarkInMs(), before, (none,) * 7, samples)
        if reached > s["grid"]:
            s["grid"] = reached
            self._save(s)
        self.handle.registerTimer(reached + self.every)
        yield frame

    def _late(self, asset: str, events: pd.DataFrame, s: dict) -> pd.DataFrame:
        numbers = s["late"] + 1 + np.arange(len(events))
        s["late"] = int(numbers[-1])
        frame = pd.DataFrame({
            "kind": "late", "a": asset, "m": events["market_id"], "p": events["price"], "b": events["best_bid"],
            "k": events["best_ask"], "seq": numbers, "rts": events["recv_ts"], "ord": events["ord"],
        })
        return frame.reindex(columns=_NAMES)

    def _rows(self, asset: str, kinds: list[tuple[str, np.ndarray]], rows: tuple, samples: Samples) -> pd.DataFrame:
        at = np.concatenate([places for _, places in kinds])
        kind = np.repeat(np.array([k for k, _ in kinds], object), [len(places) for _, places in kinds])
        ts, ord_, market, last, bid, ask, seq, count = (c[at] for c in rows)
        short, ok_short = samples.asof(ts - self.p.short_ms, count)
        long, ok_long = samples.asof(ts - self.p.long_ms, count)
        surge, _ = samples.asof(ts - self.p.surge_ms, count)
        vol, ok_vol = samples.volatility(ts - self.p.vol_ms, count)
        return pd.DataFrame({
            "kind": kind, "a": asset, "m": market, "p": last, "b": bid, "k": ask,
            "c1m": np.where(ok_short, (last - short) * 100, 0.0), "c5m": np.where(ok_long, (last - long) * 100, 0.0),
            "vol": vol, "seq": seq, "rts": ts, "ord": ord_, "ok_1m": ok_short, "ok_5m": ok_long, "ok_vol": ok_vol,
            "surge_from": surge,
        }, columns=_NAMES)

    def _grid(
        self, asset: str, grid: int, upto: int, before: tuple, now: tuple, samples: Samples
    ) -> tuple[int, pd.DataFrame]:
        """The last instant up to ``upto``, and rows of the instants after ``grid``: the state is that
        of the newest event not after the instant, of ``now`` or else ``before``."""
        instants = np.arange(grid + self.every, upto + 1, self.every)
        at = np.searchsorted(now[0], instants, side="right") - 1
        market, last, bid, ask, seq, count = (
            np.where(at >= 0, c[np.maximum(at, 0)], b) if len(c) else np.full(len(at), b)
            for c, b in zip(now[1:], before)
        )
        then, held = samples.asof(instants - self.p.long_ms, count.astype(np.int64))
        held &= last != 0
        frame = pd.DataFrame({
            "kind": "grid", "a": asset, "m": market, "p": last, "b": bid, "k": ask, "c1m": 0.0, "c5m": (last - then) * 100,
            "vol": 0.0, "seq": seq, "rts": instants, "ord": 0, "ok_1m": False, "ok_5m": True, "ok_vol": False,
            "surge_from": np.nan,
        }, columns=_NAMES)[held]
        return (int(instants[-1]) if len(instants) else grid), frame

    def close(self) -> None:
        pass


def use_rocksdb(spark) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def derive_stream(
    events: DataFrame, p: Params = Params(), initial: DataFrame | None = None, *, every: int | None = None,
    delay: str = "0 seconds", late_ms: int | None = None,
) -> DataFrame:
    """Tagged ticks, alerts and snapshots of a stream of raw events.

    ``initial``: newest snapshot per asset, tick layout
    (:func:`tickloom.operators.series.restore_state`), or another stream's whole state
    (:func:`state_of`). With ``every`` also the change at each
    multiple of so many milliseconds, for the top list; then events later than ``delay``
    behind the newest are dropped, and Spark's progress counts them
    (``numRowsDroppedByWatermark``). With ``late_ms`` late events are rows of the output
    (:func:`late_of`): every event is either applied or there.
    """
    use_rocksdb(events.sparkSession)
    # The worker that plans the operator does not see files added to the session,
    # so the processor travels with its code.
    for module in (__name__, Params.__module__):
        cloudpickle.register_pickle_by_value(sys.modules[module])
    zero, empty = F.lit(0.0), F.lit("")
    feed = events.filter(F.col("asset_id").isNotNull()).select(
        "asset_id", F.col("recv_ts").cast("bigint").alias("recv_ts"), F.col("ord").cast("bigint").alias("ord"),
        *[F.coalesce(c, zero).alias(c) for c in ("price", "best_bid", "best_ask")],
        F.coalesce("market_id", empty).alias("market_id"),
    )
    start = None
    if initial is not None and "ring_ts" in initial.columns:
        start = initial.groupBy("asset_id")
    elif initial is not None:
        start = initial.select(F.col("a").alias("asset_id"), "m", "p", "b", "k", "seq").groupBy("asset_id")
    if every:
        feed = feed.withColumn("event_time", F.timestamp_millis("recv_ts")).withWatermark("event_time", delay)
    return feed.groupBy("asset_id").transformWithStateInPandas(
        statefulProcessor=AssetProcessor(p, every, late_ms), outputStructType=OUTPUT, outputMode="Append",
        timeMode="EventTime" if every else "None", initialState=start,
    )


def state_of(spark, checkpoint: str) -> DataFrame:
    """The state of every asset in a stopped stream's checkpoint: ``asset_id`` and all that is kept,
    samples and cooldowns included. As ``initial`` it lets a new stream, with parameters of its
    own, go on where that one ended."""
    use_rocksdb(spark)
    rows = spark.read.format("statestore").option("stateVarName", "asset").load(checkpoint)
    return rows.select("key.asset_id", "value.*")


def ticks_of(derived: DataFrame, kind: str = "tick") -> DataFrame:
    """``tick`` or ``snapshot`` rows in the tick layout."""
    return derived.filter(F.col("kind") == kind).select(
        F.lit(RECORD_VERSION).alias("v"), "a", "m", "p", "b", "k", "c1m", "c5m", "vol", "seq", "rts",
        F.col("rts").alias("pts"), "ord", "ok_1m", "ok_5m", "ok_vol",
    )


def movers_of(derived: DataFrame) -> DataFrame:
    """Every asset's change at each grid instant: ``ts, a, c5m``."""
    return derived.filter(F.col("kind") == "grid").select(F.col("rts").alias("ts"), "a", "c5m")


def surges_of(derived: DataFrame) -> DataFrame:
    return derived.filter(F.col("kind") == "alert").select(
        F.col("a").alias("asset_id"), F.col("rts").alias("recv_ts"), "ord", F.col("m").alias("market_id"),
        F.col("surge_from").alias("from"), F.col("p").alias("to"),
    )


def late_of(derived: DataFrame) -> DataFrame:
    """Events that came too late to be applied, as they came, with their number ``n`` per asset."""
    return derived.filter(F.col("kind") == "late").select(
        F.col("a").alias("asset_id"), F.col("m").alias("market_id"), F.col("p").alias("price"),
        F.col("b").alias("best_bid"), F.col("k").alias("best_ask"), F.col("rts").alias("recv_ts"), "ord",
        F.col("seq").alias("n"),
    )
