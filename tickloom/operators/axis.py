"""Ordered work inside one key, cut into slices.

A window ``partitionBy(key).orderBy(ts)`` puts all rows of a key into one task.
Here each key is cut along its axis into slices of fixed width and every ordered
computation runs per ``(key, slice)``; what a slice needs from the slices before
it travels in one summary row per ``(key, slice)``. The longest thing a single
task ever orders for a whole key is that key's list of summary rows.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
#: Slices of a keyless axis that are folded together before the rest.
BLOCK = 1024


def slice_expr(ts: str | Column, width: int) -> Column:
    """Number of the slice holding ``ts`` (floor division, exact for bigints)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    ts = ts.cast("bigint")
    width_col = F.lit(width).cast("bigint")
    return F.call_function("div", ts - F.pmod(ts, width_col), width_col)


@dataclass(frozen=True)
class Axis:
    """Key, order and slice width of a series. ``order[0]`` is the sliced column."""

    key: tuple[str, ...] = ("asset_id",)
    order: tuple[str, ...] = ("recv_ts", "ord")
    width: int = 900_000
    extra: tuple[str, ...] = field(default=(), repr=False)

    @property
    def ts(self) -> str:
        return self.order[0]

    @property
    def part(self) -> list[str]:
        return [*self.key, SLICE]

    def cut(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SLICE, slice_expr(self.ts, self.width))

    def ordered(self, descending: bool = False) -> list[Column]:
        return [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]


def _carried(
    summary: DataFrame, key: list[str], at: str, sums: list[str], back: list[str], after: list[str]
) -> DataFrame:
    """``summary`` with what each place ``at`` gets from the places before and after it.

    Without a key all summaries would meet in one task: then blocks of ``BLOCK`` places are
    folded first, and only a row per block is folded in one piece.
    """
    blocks = not key
    part = ["_block"] if blocks else key
    rows = summary.withColumn("_block", slice_expr(at, BLOCK)) if blocks else summary
    over = Window.partitionBy(*part).orderBy(at)
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*part).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select(
        *part, at,
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_s_{n}") for n in sums],
        *[F.last(f"_b_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in back],
        *[F.last(f"_a_{n}", ignorenulls=True).over(later).alias(f"_a_{n}") for n in after],
    )
    if not blocks:
        return out
    whole = rows.groupBy("_block").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums],
        *[F.max_by(f"_b_{n}", F.when(F.col(f"_b_{n}").isNotNull(), F.col(at))).alias(f"_b_{n}") for n in back],
        *[F.min_by(f"_a_{n}", F.when(F.col(f"_a_{n}").isNotNull(), F.col(at))).alias(f"_a_{n}") for n in after],
    )
    everything = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    outer = whole.select(
        "_block",
        *[F.sum(f"_s_{n}").over(everything).alias(f"_os_{n}") for n in sums],
        *[F.last(f"_b_{n}", ignorenulls=True).over(everything).alias(f"_ob_{n}") for n in back],
        *[F.last(f"_a_{n}", ignorenulls=True).over(rest).alias(f"_oa_{n}") for n in after],
    )
    zero = F.lit(0)
    return out.join(outer, "_block", "left").select(
        at,
        *[(F.coalesce(f"_s_{n}", zero) + F.coalesce(f"_os_{n}", zero)).alias(f"_s_{n}") for n in sums],
        *[F.coalesce(f"_b_{n}", f"_ob_{n}").alias(f"_b_{n}") for n in back],
        *[F.coalesce(f"_a_{n}", f"_oa_{n}").alias(f"_a_{n}") for n in after],
    )


def running(
    df: DataFrame,
    axis: Axis,
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
) -> DataFrame:
    """Running values per key, exact over all its rows.

    ``sums``    running total up to and including the row
    ``lasts``   newest non-null value up to and including the row
    ``before``  newest non-null value strictly before the row
    ``after``   oldest non-null value strictly after the row

    One shuffle of the rows by ``(key, slice)``, one partial aggregation to a
    summary row per slice, one pass over the summaries of each key (in two levels
    where there is no key).
    """
    sums, lasts, before, after = sums or {}, lasts or {}, before or {}, after or {}
    order = F.struct(*[F.col(c) for c in axis.order])
    rows = axis.cut(df)

    back = {**lasts, **before}
    aggs = [F.sum(e).alias(f"_s_{n}") for n, e in sums.items()]
    aggs += [F.max_by(e, F.when(e.isNotNull(), order)).alias(f"_b_{n}") for n, e in back.items()]
    aggs += [F.min_by(e, F.when(e.isNotNull(), order)).alias(f"_a_{n}") for n, e in after.items()]
    summary = rows.groupBy(*axis.part).agg(*aggs)

    carry = _carried(summary, list(axis.key), SLICE, list(sums), list(back), list(after))
    carry = carry.select(
        *axis.part, *[f"_s_{n}" for n in sums], *[f"_b_{n}" for n in back], *[f"_a_{n}" for n in after]
    )

    local = Window.partitionBy(*axis.part).orderBy(*axis.ordered())
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    prior = local.rowsBetween(Window.unboundedPreceding, -1)
    following = (
        Window.partitionBy(*axis.part).orderBy(*axis.ordered(descending=True))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.select(
        "*",
        *[F.sum(e).over(upto).alias(f"_ls_{n}") for n, e in sums.items()],
        *[F.last(e, ignorenulls=True).over(upto).alias(f"_lb_{n}") for n, e in lasts.items()],
        *[F.last(e, ignorenulls=True).over(prior).alias(f"_lb_{n}") for n, e in before.items()],
        *[F.last(e, ignorenulls=True).over(following).alias(f"_la_{n}") for n, e in after.items()],
    )
    zero = F.lit(0)
    taken = {*sums, *back, *after}
    return rows.join(carry, axis.part, "left").select(
        *[c for c in df.columns if c not in taken],
        *[
            (F.coalesce(F.col(f"_ls_{n}"), zero) + F.coalesce(F.col(f"_s_{n}"), zero)).alias(n)
            for n in sums
        ],
        *[F.coalesce(F.col(f"_lb_{n}"), F.col(f"_b_{n}")).alias(n) for n in back],
        *[F.coalesce(F.col(f"_la_{n}"), F.col(f"_a_{n}")).alias(n) for n in after],
    )
