"""Chart series as a stream: the last price of every second, newest seconds only."""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.series import retain_last_n
from tickloom.streaming.processor import use_rocksdb

_POINT = ["t", "pts", "seq", "p"]


class Chart(StatefulProcessor):
    """The newest ``n`` buckets of one asset; a row for each that a micro-batch made or changed.

    A bucket below the ``n`` newest is gone for good: a tick that comes for it later finds no
    place, as in a chart that has moved on.
    """

    def __init__(self, n: int, bucket_ms: int) -> None:
        self.n, self.bucket_ms = n, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getValueState(
            "points", "t array<bigint>, pts array<bigint>, seq array<bigint>, p array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = new.assign(t=new["pts"] // self.bucket_ms)[_POINT]
        held = pd.DataFrame(dict(zip(_POINT, map(np.asarray, self.points.get()))) if self.points.exists() else {c: [] for c in _POINT})
        both = pd.concat([held.assign(old=True), new.assign(old=False)], ignore_index=True)
        # of equal ticks the one that came first stays
        both = both.sort_values(["t", "pts", "seq"], kind="stable")
        both = both[~both.duplicated(["t", "pts", "seq"])].drop_duplicates("t", keep="last").tail(self.n)
        self.points.update(tuple(both[c].tolist() if c == "p" else both[c].astype("int64").tolist() for c in _POINT))
        made = both[~both["old"].astype(bool)]
        yield pd.DataFrame({"a": key[0], **{c: made[c] for c in _POINT}}).astype({c: "int64" for c in _POINT[:3]})

    def close(self) -> None:
        pass


def stream_chart(ticks: DataFrame, n: int = 900, bucket_ms: int = 1_000) -> DataFrame:
    """Upserts ``a, t, pts, seq, p`` of the chart of each asset. The newest upsert of each ``a, t``,
    cut to ``n`` (:func:`chart_now`), is the chart after the micro-batches so far."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    use_rocksdb(ticks.sparkSession)
    feed = ticks.filter("a is not null").select("a", *[F.col(c).cast("bigint").alias(c) for c in ("pts", "seq")], "p")
    return feed.groupBy("a").transformWithStateInPandas(
        statefulProcessor=Chart(n, bucket_ms), outputStructType="a string, t bigint, pts bigint, seq bigint, p double",
        outputMode="Append", timeMode="None",
    )


def chart_now(upserts: DataFrame, n: int = 900) -> DataFrame:
    """``a, t, p`` from the upserts written so far."""
    newest = upserts.groupBy("a", "t").agg(F.max_by("p", F.struct("pts", "seq")).alias("p"))
    return retain_last_n(newest, n, key=("a",), order=("t",))
