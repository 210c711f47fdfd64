"""Serving in streams: subscriptions that change while messages flow, and conflation by timers.

The batch forms are in :mod:`tickloom.operators.serving`; over the same rows the results are equal.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.wire import envelope, envelope_one
from tickloom.streaming.ordered import CHUNK, EVENT_TIME, InOrder, in_order, timed, use_event_time


class Requests(InOrder):
    """The subscribed keys of each client; a row for each key gained or lost."""

    columns = ("ts", "ord", "op", "ch", "ids")

    def __init__(self, cap: int, client: str) -> None:
        self.cap = cap
        self.output = (
            f"{EVENT_TIME} timestamp", f"client_id {client}", "ch string", "id string", "ts bigint", "ord bigint",
            "step int", "error string", "live bigint", "joined int",
        )

    def apply(self, state: dict, rows: list[tuple]) -> Iterator[tuple]:
        for client, ts, ord_, op, ch, ids in rows:
            held = state.get(client, {})
            was, steps = len(held), []
            asked = [("asset", i) for i in ids or ()] if ch == "asset" else [(ch, "")]
            if op == "close":
                steps = [(k, -1) for k in sorted(held)]
                held = {}
            elif op == "unsub":
                for k in asked:
                    if k in held:
                        del held[k]
                        steps.append((k, -1))
            elif op == "sub":
                if self.cap > 0 and len(held) + sum(k not in held for k in asked) > self.cap:
                    yield client, ch, None, ts, ord_, 0, "too_many_subs", was, 0
                    continue
                for k in asked:
                    if k not in held:
                        held[k] = None
                        steps.append((k, 1))
            if held:
                state[client] = held
            else:
                state.pop(client, None)
            # the client as a whole joins or leaves with the last key of the request
            change = (len(held) > 0) - (was > 0)
            for n, (k, step) in enumerate(steps):
                last = n == len(steps) - 1
                yield client, *k, ts, ord_, step, None, len(held), change if last else 0


def stream_steps(ops: DataFrame, cap: int = 500, delay: str = "0 seconds", *, chained: bool = False) -> DataFrame:
    """:func:`tickloom.operators.serving.apply_subscription_ops` as a stream, with the client's
    ``live`` keys afterwards and ``joined`` (1, -1 where the client as a whole comes or goes)."""
    kind = dict(ops.dtypes)["client_id"]
    rows = timed(ops.select("client_id", "ts", "ord", "op", "ch", "ids"), delay)
    return in_order(rows, ("client_id",), Requests(cap, kind), chained=chained)


class Deliveries(InOrder):
    """The subscribed clients of each key; a row for each message and client."""

    # a step counts for the message of its own instant
    order = ("ts", "ord", "side")

    columns = ("ts", "ord", "side", "client_id", "step", "value")

    def __init__(self, client: str) -> None:
        self.output = (f"client_id {client}", "ch string", "id string", "ts bigint", "ord bigint", "value string")

    def frames(self, state: dict, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        clients, sent, counts = [], [], []
        for ch, id_, part, ts, ord_, side, client, step, value in rows:
            key = (ch, id_, part)
            if side:
                if key in state:
                    clients.extend(state[key])
                    sent.append((ch, id_, ts, ord_, value))
                    counts.append(len(state[key]))
                    if len(clients) >= CHUNK:
                        yield self._sent(clients, sent, counts)
                        clients, sent, counts = [], [], []
            elif step > 0:
                state.setdefault(key, {})[client] = None
            elif key in state:
                state[key].pop(client, None)
                if not state[key]:
                    del state[key]
        yield self._sent(clients, sent, counts)

    def _sent(self, clients: list, sent: list[tuple], counts: list[int]) -> pd.DataFrame:
        """A row for each client of each message, in whole columns."""
        if not sent:
            return self._frame([])
        messages = pd.DataFrame(sent, columns=[c.split()[0] for c in self.output[1:]])
        rows = messages.iloc[np.repeat(np.arange(len(sent)), counts)].reset_index(drop=True)
        rows.insert(0, "client_id", clients)
        return rows


def stream_fanout(
    messages: DataFrame, ops: DataFrame, *, cap: int = 0, delay: str = "0 seconds", parts: int = 1
) -> DataFrame:
    """Each message to every client subscribed to its key at its time, while requests come in.

    ``messages``: ``ch, id, ts, ord, value``; ``ops``: ``client_id, ts, ord, op, ch, ids``. Two
    stateful operators: requests become steps per client, steps and messages meet per key.
    ``parts`` spreads the messages of every key over as many tasks; each keeps the key's clients.
    The newest row of either input moves the clock; ``delay`` is what rows may come late.
    """
    steps = stream_steps(ops, cap, delay, chained=True).filter("step <> 0")
    kind = dict(steps.dtypes)["client_id"]
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    left = steps.select(
        "ch", "id", every, EVENT_TIME, "ts", "ord", F.lit(0).alias("side"), "client_id", "step",
        F.lit(None).cast("string").alias("value"),
    )
    right = timed(messages, delay).select(
        "ch", "id", F.pmod(F.xxhash64("ts", "ord"), F.lit(parts)).cast("int").alias("part"), EVENT_TIME, "ts", "ord",
        F.lit(1).alias("side"), F.lit(0).cast(kind).alias("client_id"), F.lit(0).alias("step"), "value",
    )
    return in_order(left.unionByName(right), ("ch", "id", "part"), Deliveries(kind))


class Totals(InOrder):
    """Running totals over all clients, one row per instant."""

    columns = ("ts", "step", "joined")
    order = ("ts",)
    output = ("ts bigint", "subscriptions bigint", "clients bigint")

    def apply(self, state: dict, rows: list[tuple]) -> Iterator[tuple]:
        for key, ts, step, joined in rows:
            subscriptions, clients = state.get(key, (0, 0))
            state[key] = subscriptions + step, clients + joined
            yield ts, *state[key]


def stream_subscription_counts(ops: DataFrame, cap: int = 0, delay: str = "0 seconds") -> DataFrame:
    """:func:`tickloom.operators.serving.subscription_counts` as a stream.

    Steps are made per client and summed per instant in all tasks; one row per instant
    reaches the running totals.
    """
    steps = stream_steps(ops, cap, delay, chained=True)
    sums = steps.groupBy(EVENT_TIME, "ts").agg(
        F.sum("step").cast("bigint").alias("step"), F.sum("joined").cast("bigint").alias("joined"))
    return in_order(sums.withColumn("all", F.lit(0)), ("all",), Totals())


class Accepted(Requests):
    """The keys asked for by the requests of each client that its cap lets through."""

    def __init__(self, cap: int, client: str) -> None:
        super().__init__(cap, client)
        self.output = (
            f"{EVENT_TIME} timestamp", f"client_id {client}", "ts bigint", "ord bigint", "ch string", "pos int", "id string")

    def apply(self, state: dict, rows: list[tuple]) -> Iterator[tuple]:
        refused = {(step[0], *step[3:5]) for step in super().apply(state, rows) if step[6] is not None}
        for client, ts, ord_, op, ch, ids in rows:
            if op == "sub" and (client, ts, ord_) not in refused:
                wanted = [""] if ch == "top" else (ids or []) if ch == "asset" else []
                for pos, i in enumerate(wanted):
                    yield client, ts, ord_, ch, pos, i


class Known(InOrder):
    """The newest value of each key; a row for each request that finds one."""

    # a request sees the messages of its own instant
    order = ("ts", "side", "ord")
    columns = ("ts", "ord", "side", "client_id", "pos", "value")

    def __init__(self, client: str) -> None:
        self.output = (
            f"{EVENT_TIME} timestamp", f"client_id {client}", "ts bigint", "ord bigint", "ch string", "pos int", "value string")

    def apply(self, state: dict, rows: list[tuple]) -> Iterator[tuple]:
        for ch, id_, part, ts, ord_, side, client, pos, value in rows:
            if not side:
                state[ch, id_, part] = value
            elif (newest := state.get((ch, id_, part))) is not None:
                yield client, ts, ord_, ch, pos, newest


def stream_snapshots(
    ops: DataFrame, messages: DataFrame, *, cap: int = 0, delay: str = "0 seconds", parts: int = 1
) -> DataFrame:
    """:func:`tickloom.operators.serving.snapshot_on_subscribe` as a stream: requests are answered
    with what is known at their moment, while messages flow.

    ``messages``: ``ch, id, ts, ord, value`` with ``ch`` ``asset`` or ``top`` (``id`` is ignored
    there). With a ``cap`` refused requests get no answer. ``parts`` spreads the requests for
    every key over as many tasks, each with the key's newest value. An answer is put together
    from its keys when the clock, moved by the newest row of either input, has passed it.
    """
    kind = dict(ops.dtypes)["client_id"]
    rows = timed(ops.select("client_id", "ts", "ord", "op", "ch", "ids"), delay)
    if cap > 0:
        asked = in_order(rows, ("client_id",), Accepted(cap, kind), chained=True)
    else:
        ids = F.when(F.col("ch") == "top", F.array(F.lit(""))).when(F.col("ch") == "asset", F.col("ids"))
        asked = rows.filter(F.col("op") == "sub").select(
            EVENT_TIME, "client_id", "ts", "ord", "ch", F.posexplode(ids).alias("pos", "id"))
    left = asked.select(
        "ch", "id", F.pmod(F.xxhash64("client_id", "ts", "ord"), F.lit(parts)).cast("int").alias("part"), EVENT_TIME,
        "ts", "ord", F.lit(1).alias("side"), "client_id", "pos", F.lit(None).cast("string").alias("value"))
    right = timed(messages.filter(F.col("value").isNotNull()), delay).select(
        "ch", F.when(F.col("ch") == "top", "").otherwise(F.col("id")).alias("id"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), EVENT_TIME, "ts", "ord", F.lit(0).alias("side"),
        F.lit(0).cast(kind).alias("client_id"), F.lit(0).alias("pos"), "value")
    found = in_order(left.unionByName(right), ("ch", "id", "part"), Known(kind), chained=True)
    items = F.array_sort(F.collect_list(F.struct("pos", "value")))
    answers = found.groupBy(EVENT_TIME, "client_id", "ts", "ord", "ch").agg(
        F.transform(items, lambda i: i["value"]).alias("items"))
    snap = F.col("ch") == "asset"
    return answers.select(
        "client_id", "ts", "ord", F.when(snap, "snap").otherwise("top").alias("t"), F.size("items").alias("n"),
        F.when(snap, envelope("snap", "items")).otherwise(envelope_one("top", F.get("items", F.lit(0)))).alias("frame"))


def stream_conflate(
    deliveries: DataFrame, flush_ms: int = 50, *, value: str = "value", delay: str = "0 seconds"
) -> DataFrame:
    """:func:`tickloom.operators.serving.conflate` as a stream: the newest value of each key is kept
    per client and flush window, and a window is sent when the watermark has passed it. Alerts
    and sys messages are sent at once.

    Rows without ``ch`` only move the clock, so that the last windows are sent as well.
    """
    use_event_time(deliveries.sparkSession)
    rows = timed(deliveries.select("client_id", "ts", "ord", "ch", "id", F.col(value).alias("value")), delay)
    width = max(flush_ms, 1)
    window = F.window(EVENT_TIME, f"{width} milliseconds").alias("window")
    newest = F.max_by("value", F.struct("ts", "ord")).alias("value")
    # clock rows leave after the sums only: a filter on the rows would go below the watermark
    pending = rows.groupBy(window, "client_id", "ch", "id").agg(newest, F.max("ch").alias("kind"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda i: i["value"])
    sent = pending.filter(F.col("kind").isin("asset", "top")).groupBy("window", "client_id", "ch").agg(items.alias("items"))
    ticks = F.col("ch") == "asset"
    due = sent.select(
        "client_id", F.unix_millis("window.start").alias("flush"), F.when(ticks, "ticks").otherwise(F.col("ch")).alias("t"),
        F.when(ticks, F.size("items")).otherwise(1).alias("n"),
        F.when(ticks, envelope("ticks", "items")).otherwise(envelope_one("top", F.element_at("items", -1))).alias("frame"),
    )
    kind = F.when(F.col("ch") == "alerts", "alert").otherwise(F.col("ch"))
    at_once = deliveries.filter(F.col("ch").isin("alerts", "sys")).select(
        "client_id", (F.col("ts") - F.pmod("ts", F.lit(width))).alias("flush"), kind.alias("t"), F.lit(1).alias("n"),
        envelope_one(kind, F.col(value)).alias("frame"))
    return due.unionByName(at_once)
