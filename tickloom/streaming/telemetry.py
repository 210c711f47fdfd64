"""System statistics as a stream: rates, live clients and a trailing percentile per window.

The batch form is :func:`tickloom.operators.telemetry.sys_stats`; results are equal.
"""
from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.streaming.ordered import EVENT_TIME, InOrder, in_order, timed, use_event_time

_SAMPLES = "array<struct<ts: bigint, ord: bigint, latency: double>>"
_PART = f"came bigint, went bigint, step bigint, samples {_SAMPLES}"


class Parts(StatefulProcessor):
    """What one part of the rows adds to each window: counts, and the ``last`` newest samples.

    A window's row leaves when the watermark has passed the window.
    """

    def __init__(self, window_ms: int, last: int) -> None:
        self.window_ms, self.last = window_ms, last
        self.output = f"{EVENT_TIME} timestamp, start bigint, {_PART}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "start bigint", _PART)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = set()
        for frame in rows:
            frame = frame.assign(start=frame["ts"] // self.window_ms * self.window_ms)
            for start, part in frame.groupby("start"):
                start = int(start)
                if self.windows.containsKey((start,)):
                    came, went, step, samples = self.windows.getValue((start,))
                else:
                    came, went, step, samples = 0, 0, 0, []
                usable = part[(part["side"] == "in") & (part["latency_ms"] >= 0)]
                new = zip(usable["ts"].tolist(), usable["ord"].tolist(), usable["latency_ms"].tolist())
                newest = sorted([*map(tuple, samples), *new])[-self.last:]
                self.windows.updateValue((start,), (
                    came + int((part["side"] == "in").sum()), went + int((part["side"] == "out").sum()),
                    step + int(part["step"].sum()), newest,
                ))
                seen.add(start)
        for start in seen:
            self.handle.registerTimer(start + self.window_ms - 1)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        at = (end - self.window_ms + 1,)
        came, went, step, samples = self.windows.getValue(at)
        self.windows.removeKey(at)
        yield self._frame([(pd.Timestamp(end, unit="ms"), *at, came, went, step, list(map(tuple, samples)))])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[EVENT_TIME, "start", "came", "went", "step", "samples"])

    def close(self) -> None:
        pass


class Stats(InOrder):
    """Merges the parts of each window: clients so far, and a ring of the ``last`` newest samples
    beside the same samples by value, so that a percentile is one look-up."""

    columns = ("start", "end", "came", "went", "step", "samples")
    order = ("end",)
    output = ("start bigint", "clients bigint", "in_eps double", "out_mps double", "p99_ms double")

    def __init__(self, window_ms: int, p: float, last: int) -> None:
        self.window_ms, self.p, self.last = window_ms, p, last

    def apply(self, state: dict, rows: list[tuple]) -> Iterator[tuple]:
        clients, ring = state.get("all", (0, []))
        by_value = sorted(s[2] for s in ring)
        windows: dict[int, list[dict]] = {}
        for row in rows:
            windows.setdefault(row[1], []).append(dict(zip(self.names, row)))
        for start, parts in sorted(windows.items()):
            clients += sum(r["step"] for r in parts)
            for sample in sorted(tuple(s) for r in parts for s in r["samples"] or ())[-self.last:]:
                ring.append(sample)
                insort(by_value, sample[2])
            over = max(len(ring) - self.last, 0)
            for old in ring[:over]:
                del by_value[bisect_left(by_value, old[2])]
            del ring[:over]
            came, went = (sum(r[c] for r in parts) for c in ("came", "went"))
            if came or went:
                n, second = len(by_value), 1000.0 / self.window_ms
                slow = by_value[min(int(n * self.p) + 1, n) - 1] if n else 0.0
                yield start, clients, came * second, went * second, slow
        state["all"] = clients, ring


def stream_sys_stats(
    inputs: DataFrame, outputs: DataFrame, sessions: DataFrame, *, window_ms: int = 1_000, p: float = 0.99,
    last: int = 4096, delay: str = "0 seconds", parts: int = 64, clock: DataFrame | None = None,
) -> DataFrame:
    """One row per window with traffic: ``start, clients, in_eps, out_mps, p99_ms``.

    ``inputs``: ``ts, ord, latency_ms``; ``outputs``: ``ts``; ``sessions``: ``ts, step`` (1 when a
    client connects, -1 when it leaves); ``clock``: ``ts`` rows that only move the time. Rows are
    dealt to ``parts`` tasks; each sends at most ``last`` samples of a window on, and the merge
    keeps ``last`` samples in all.
    """
    kinds = {"ord": "bigint", "latency_ms": "double", "step": "bigint"}

    def side(df: DataFrame, name: str, *given: str) -> DataFrame:
        rest = [(F.col(c) if c in given else F.lit(None if c == "latency_ms" else 0)).cast(t).alias(c) for c, t in kinds.items()]
        return df.select(F.col("ts").cast("bigint").alias("ts"), F.lit(name).alias("side"), *rest)

    rows = side(inputs, "in", "ord", "latency_ms").unionByName(side(outputs, "out")).unionByName(side(sessions, "step", "step"))
    if clock is not None:
        rows = rows.unionByName(side(clock, "clock"))
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    use_event_time(inputs.sparkSession)
    dealt = timed(rows, delay).withColumn("part", F.pmod(F.xxhash64("ts", "ord", "side"), F.lit(parts)))
    made = Parts(window_ms, last)
    windows = dealt.groupBy("part").transformWithStateInPandas(
        statefulProcessor=made, outputStructType=made.output, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName=EVENT_TIME,
    )
    merged = windows.withColumns({"all": F.lit(0), "end": F.col("start") + (window_ms - 1)})
    return in_order(merged, ("all",), Stats(window_ms, p, last))

