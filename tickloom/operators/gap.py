"""Greedy minimum-gap selection: keep a row iff it is at least ``gap`` after the
last kept row of its key.

The choice in one slice depends on the last kept row before it, so each slice is
first reduced to a small table "first row taken here -> last row kept here"
(rows of one slice reach their last kept row by pointer doubling). Those tables
are folded along each key, which gives every slice its starting state, and the
slices are then walked independently.

Ties are dropped first, so one slice holds at most ``width`` points whatever the
event rate, and a fold step reads at most ``gap + 1`` entries.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.axis import SLICE, Axis

_HOUR_MS = 3_600_000
_MIN_CELLS = 4


def slice_width(gap: int) -> int:
    """Whole number of gaps, about an hour, so that summaries stay small."""
    return gap * max(_MIN_CELLS, -(-_HOUR_MS // gap))


def _whole_groups(batches: Iterator[pd.DataFrame], part: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no ``part`` group spans two frames."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        tail = np.ones(len(pdf), dtype=bool)
        for c in part:
            tail &= (pdf[c] == pdf[c].iloc[-1]).to_numpy()
        start = int(np.argmax(tail))
        if start == 0 and held and all(held[-1][c].iloc[-1] == pdf[c].iloc[0] for c in part):
            held.append(pdf)
            continue
        if start:
            yield pd.concat([*held, pdf.iloc[:start]], ignore_index=True)
        elif held:
            yield pd.concat(held, ignore_index=True)
        held = [pdf.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _links(pdf: pd.DataFrame, part: list[str], ts: str, gap: int, width: int):
    """Group starts, group ends per row, offsets and the next row >= gap later."""
    n = len(pdf)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in part:
        col = pdf[c].to_numpy()
        new[1:] |= col[1:] != col[:-1]
    starts = np.flatnonzero(new)
    gid = np.cumsum(new) - 1
    ends = np.append(starts[1:], n)
    offset = pdf[ts].to_numpy(dtype=np.int64) - pdf[SLICE].to_numpy(dtype=np.int64) * width
    line = gid.astype(np.int64) * (width + gap + 1) + offset
    following = np.searchsorted(line, line + gap)
    return starts, ends, gid, offset, line, following


def _summaries(part: list[str], ts: str, gap: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches, part):
            starts, ends, gid, offset, line, following = _links(pdf, part, ts, gap, width)
            here = np.arange(len(pdf))
            last = np.where(following < ends[gid], following, here)
            while True:
                further = last[last]
                if np.array_equal(further, last):
                    break
                last = further
            entry = offset < gap
            beyond = np.searchsorted(
                line, np.arange(len(starts), dtype=np.int64) * (width + gap + 1) + gap
            )
            entry[beyond[beyond < ends]] = True
            rows = np.flatnonzero(entry)
            # entries leading to the same last row: only the latest is needed
            keep = np.append(last[rows[1:]] != last[rows[:-1]], True)
            rows = rows[keep]
            out = pdf.iloc[rows][part].copy()
            stamps = pdf[ts].to_numpy()
            out["_entry"] = stamps[rows]
            out["_exit"] = stamps[last[rows]]
            yield out

    return run


def _fold(key: list[str], gap: int):
    part = [*key, SLICE]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, state = None, None
        for pdf in _whole_groups(batches, part):
            new = np.zeros(len(pdf), dtype=bool)
            new[0] = True
            for c in part:
                col = pdf[c].to_numpy()
                new[1:] |= col[1:] != col[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(pdf))
            entry = pdf["_entry"].to_numpy(dtype=np.int64)
            leave = pdf["_exit"].to_numpy(dtype=np.int64)
            owners = list(zip(*[pdf[c].to_numpy()[starts] for c in key])) if key else [()] * len(starts)
            carried: list[int | None] = []
            for lo, hi, who in zip(starts, ends, owners):
                if who != owner:
                    owner, state = who, None
                carried.append(state)
                at = lo if state is None else lo + int(np.searchsorted(entry[lo:hi], state + gap))
                if at < hi:
                    state = int(leave[at])
            out = pdf.iloc[starts][part].copy()
            out["_carry"] = pd.array(carried, dtype="Int64")
            yield out

    return run


def _walk(columns: list[str], part: list[str], ts: str, gap: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_groups(batches, part):
            starts, ends, _, _, _, following = _links(pdf, part, ts, gap, width)
            stamps = pdf[ts].to_numpy(dtype=np.int64)
            carry = pd.to_numeric(pdf["_carry"]).to_numpy(dtype=np.float64, na_value=np.nan)
            step = following.tolist()
            kept: list[int] = []
            for lo, hi in zip(starts.tolist(), ends.tolist()):
                at = lo
                if not np.isnan(carry[lo]):
                    at += int(np.searchsorted(stamps[lo:hi], int(carry[lo]) + gap))
                while at < hi:
                    kept.append(at)
                    at = step[at]
            yield pdf.iloc[kept][columns]

    return run


def sample_min_gap(
    df: DataFrame,
    gap: int,
    *,
    key: tuple[str, ...] = ("asset_id",),
    order: tuple[str, ...] = ("recv_ts", "ord"),
    payload: tuple[str, ...] = (),
    width: int | None = None,
) -> DataFrame:
    """Kept points as ``key + order + payload``; exactly ``gap`` apart is kept.

    ``width`` sets the slice width, to share a shuffle with other sliced work.
    """
    if gap <= 0:
        raise ValueError("gap must be positive")
    width = slice_width(gap) if width is None or width < _MIN_CELLS * gap else width
    axis = Axis(key, order, width)
    columns = [*key, *order, *[c for c in payload if c not in order and c not in key]]
    keyed = df.select(*columns)
    for c in (*key, axis.ts):
        keyed = keyed.filter(F.col(c).isNotNull())
    keyed = axis.cut(keyed.withColumn(axis.ts, F.col(axis.ts).cast("bigint")))
    local = Window.partitionBy(*axis.part).orderBy(*axis.ordered())
    points = (
        keyed.withColumn("_prev", F.lag(axis.ts).over(local))
        .filter(F.col("_prev").isNull() | (F.col("_prev") < F.col(axis.ts)))
        .drop("_prev")
    )
    types = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    part_ddl = ", ".join(f"`{c}` {types[c]}" for c in axis.part)

    tables = (
        points.sortWithinPartitions(*axis.part, *order)
        .mapInPandas(
            _summaries(axis.part, axis.ts, gap, width), f"{part_ddl}, _entry bigint, _exit bigint"
        )
    )
    carry = (
        (tables.repartition(*key) if key else tables.coalesce(1))
        .sortWithinPartitions(*axis.part, "_entry")
        .mapInPandas(_fold(list(key), gap), f"{part_ddl}, _carry bigint")
    )
    out_ddl = ", ".join(f"`{c}` {types[c]}" for c in columns)
    return (
        points.join(carry, axis.part, "left")
        .sortWithinPartitions(*axis.part, *order)
        .mapInPandas(_walk(columns, axis.part, axis.ts, gap, width), out_ddl)
    )
