"""Messages between server and clients, as JSON text columns.

Payloads that are already JSON are never decoded: envelopes are concatenations.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.schemas import CLIENT_MESSAGE, PROTO_VERSION, TOP
from tickloom.session import once


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def envelope(kind: str | Column, items: str | Column) -> Column:
    """``{"t":kind,"d":[items]}`` from an array of JSON texts; ``kind`` is a literal or a column."""
    return F.concat(
        F.lit('{"t":"'), _text(kind), F.lit('","d":['), F.array_join(_col(items), ","), F.lit("]}")
    )


def envelope_one(kind: str | Column, item: str | Column) -> Column:
    """``{"t":kind,"d":item}`` from one JSON text."""
    return F.concat(F.lit('{"t":"'), _text(kind), F.lit('","d":'), _col(item), F.lit("}"))


def _message(kind: str, **fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("t"), *[v.alias(k) for k, v in fields.items()]))


def hello(server: str | Column) -> Column:
    return _message("hello", server=F.nullif(_text(server), F.lit("")), proto=F.lit(PROTO_VERSION))


def error(code: str | Column, text: str | Column) -> Column:
    return _message("err", code=F.nullif(_text(code), F.lit("")), msg=F.nullif(_text(text), F.lit("")))


def pong(t0: str | Column, srv: str | Column) -> Column:
    """Column arguments; a zero clock is left out of the message."""
    return _message("pong", t0=F.nullif(_col(t0), F.lit(0)), srv=F.nullif(_col(srv), F.lit(0)))


def sys_message(stats: Column) -> Column:
    return envelope_one("sys", F.to_json(stats))


def client_messages(df: DataFrame, text: str = "text") -> DataFrame:
    """Decode client messages; malformed text and unknown ops are dropped."""
    known = once(df, "_m", F.from_json(text, CLIENT_MESSAGE))
    return known.filter(F.col("_m.op").isin("sub", "unsub", "ping")).select(
        *df.columns, F.col("_m.op").alias("op"), F.col("_m.ch").alias("ch"),
        F.coalesce("_m.ids", F.array().cast("array<string>")).alias("ids"),
        F.coalesce("_m.t", F.lit(0)).alias("t"),
    )


def unwrap_top(record: str | Column) -> Column:
    """Top-list record to the bare JSON array of its entries."""
    return F.to_json(F.from_json(_col(record), TOP)["d"])
