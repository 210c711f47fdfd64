"""Numbers that arrive as strings, and small numeric helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings of a number on the wire.
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITE = r"^(?i)[+-]?inf(inity)?$"
_NAN = r"^(?i)nan$"
_INTEGER = r"^[+-]?[0-9]+$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num_or_zero(text: str | Column) -> Column:
    """Decimal string to double; empty, malformed and out-of-range become 0."""
    text = _col(text)
    value = text.try_cast("double")
    finite = F.when(F.abs(value) != F.lit(float("inf")), value)
    special = F.when(text.rlike(_NAN), F.lit(float("nan"))).when(
        text.rlike(_INFINITE),
        F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
    )
    return F.coalesce(F.when(text.rlike(_DECIMAL), finite).otherwise(special), F.lit(0.0))


def int_or_zero(text: str | Column) -> Column:
    """Integer string to bigint; empty, malformed and out-of-range become 0."""
    text = _col(text)
    return F.coalesce(F.when(text.rlike(_INTEGER), text.try_cast("bigint")), F.lit(0).cast("bigint"))


def clamp(value: str | Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(_col(value), F.lit(hi)))


def intensity(change: str | Column, most: float = 10.0) -> Column:
    """Share of ``most`` covered by a change, at most 1."""
    return F.least(F.lit(1.0), F.abs(_col(change)) / F.lit(most))


def mid_price(bid: str | Column, ask: str | Column) -> Column:
    return (_col(bid) + _col(ask)) / 2


def hour_of(ms: str | Column) -> tuple[Column, Column]:
    """UTC date and hour text of an epoch-millisecond column, in any session time zone."""
    return _utc_date(ms), _digits(F.pmod(_units(ms, 3_600_000), F.lit(24)), 2)


def _units(ms: str | Column, size: int) -> Column:
    """Whole units of ``size`` milliseconds since the epoch, rounded down."""
    ms = _col(ms).cast("bigint")
    return F.call_function("div", ms - F.pmod(ms, F.lit(size)), F.lit(size).cast("bigint"))


def _digits(value: Column, n: int) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def _utc_date(ms: str | Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), _units(ms, 86_400_000).cast("int")).cast("string")


def iso_millis(ms: str | Column) -> Column:
    """Epoch milliseconds as UTC ISO text with millisecond precision, in any session time zone."""
    part = lambda size, of, n: _digits(F.pmod(_units(ms, size), F.lit(of)), n)
    return F.concat(
        _utc_date(ms), F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"),
        part(1_000, 60, 2), F.lit("."), part(1, 1_000, 3), F.lit("Z"),
    )


def whole_seconds(ms: str | Column) -> Column:
    """Milliseconds to seconds, halves rounded up."""
    return F.floor(_col(ms) / 1000 + 0.5)
