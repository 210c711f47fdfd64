"""The batch job: raw events in; ticks, alerts, snapshots and top list out."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tickloom.operators import joins, series
from tickloom.operators.gap import sample_min_gap
from tickloom.params import Params
from tickloom.session import durable


@dataclass(frozen=True)
class Derived:
    ticks: DataFrame
    alerts: DataFrame
    snapshots: DataFrame
    top: DataFrame | None


def build_alerts(
    events: DataFrame, markets: DataFrame, p: Params = Params(), *, order: tuple[str, ...] = ()
) -> DataFrame:
    """Surges with their market's question and outcome, in the alert layout."""
    surges = series.detect_surges(events, p)
    return joins.as_alerts(joins.enrich_alerts(surges, markets, order=order), p.surge_window_s)


def process(
    events: DataFrame, markets: DataFrame, p: Params = Params(), *, at: int | None = None,
    initial: DataFrame | None = None, keep_rows: bool = False, order: tuple[str, ...] = (),
    fit: bool = False,
) -> Derived:
    """All derived records of a batch of raw events (with ``ord``, see
    :func:`tickloom.sources.frames.ordered`).

    ``order`` names the version columns of ``markets`` where it is a change log; alerts
    take the newest version.

    ``fit`` chooses the slice width from the data first. ``keep_rows`` writes the state rows to the checkpoint folder once, so that the
    three outputs do not each run the state plan.
    """
    if fit:
        p = series.fit_slices(events, p)
    rows = series.state_rows(events, p, marks=series.snapshot_marks(events, p), initial=initial)
    if keep_rows:
        rows = durable(rows.filter("changed or marked"))
    surges = sample_min_gap(
        series.surge_candidates(rows, p), p.cooldown_ms, payload=("market_id", "from", "to")
    )
    alerts = joins.as_alerts(joins.enrich_alerts(surges, markets, order=order), p.surge_window_s)
    top = series.top_movers(events, at, p) if at is not None else None
    return Derived(
        series.as_ticks(rows.filter("changed")), alerts, series.as_ticks(rows.filter("marked")), top
    )
