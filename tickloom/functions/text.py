"""Display text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct(price: str | Column) -> Column:
    """0.634 -> ``63.4%``."""
    return F.format_string("%.1f%%", _col(price) * 100)


def pp(change: str | Column) -> Column:
    """3.4 -> ``+3.4pp``; only a positive change is signed."""
    change = _col(change)
    return F.concat(F.when(change > 0, "+").otherwise(""), F.format_string("%.1fpp", change))


def truncate(text: str | Column, n: int) -> Column:
    """At most ``n`` characters, the last one an ellipsis when cut."""
    text = _col(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit(ELLIPSIS))).otherwise(text)


def surge_line(outcome: str | Column, start: str | Column, end: str | Column, window_s: str | Column) -> Column:
    """``Yes: 41.0% → 58.0% in 60s``."""
    return F.concat(
        F.coalesce(_col(outcome), F.lit("")), F.lit(": "), pct(start), F.lit(" → "), pct(end),
        F.lit(" in "), _col(window_s).cast("string"), F.lit("s"),
    )
