"""Raw feed frames to typed events.

A frame is one JSON object or an array of objects; every number in it is a
string. One bad element rejects the whole frame, an unknown event type only
skips that element.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.numbers import int_or_zero, mid_price, num_or_zero
from tickloom.session import once
from tickloom.schemas import EVENT_TYPES, FEED_SOURCE, FRAME, RECORD_VERSION

HEARTBEAT = "PONG"  # fixed value

# A known field followed by a value of the wrong JSON type, anywhere in the text: such a
# frame is looked at element by element.
_TEXT_FIELDS = (
    "event_type|market|asset_id|timestamp|price|size|side|best_bid|best_ask|"
    "last_trade_price|old_tick_size|new_tick_size"
)
_MISTYPED = (
    rf'"(?:{_TEXT_FIELDS})"\s*:\s*(?!["n\s])'
    r'|"(?:bids|asks|price_changes)"\s*:\s*(?![\[n\s])'
)
_NUMBERS = ("price", "best_bid", "best_ask", "size", "old_tick_size", "new_tick_size")


# The fields of each event type that must be texts, and its lists.
_LEVEL = ("price", "size")
_OWN = {
    "book": (("market", "asset_id", "timestamp", "last_trade_price"), {"bids": _LEVEL, "asks": _LEVEL}),
    "price_change": (("market", "timestamp"), {
        "price_changes": ("asset_id", "price", "size", "side", "best_bid", "best_ask")}),
    "last_trade_price": (("market", "asset_id", "price", "size", "side", "timestamp"), {}),
    "tick_size_change": (("market", "asset_id", "old_tick_size", "new_tick_size", "timestamp"), {}),
}


def filter_heartbeats(frames: DataFrame, frame: str = "frame") -> DataFrame:
    return frames.filter(F.col(frame) != HEARTBEAT)


def _decoded(body: Column) -> Column:
    """The frame as ``{"e":[elements]}``.

    The wrapping makes trailing text inside the frame an error, too.
    """
    return F.from_json(
        body, f"e array<struct<{_as_struct(FRAME)}>>, _bad string", {"columnNameOfCorruptRecord": "_bad"},
    )


def _is(value: Column, path: str, kind: str) -> Column:
    """The value at ``path`` is absent, null, or of that JSON kind."""
    found = F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID"))
    return found.startswith(kind) | (found == "VOID")


def _entry_test(fields: tuple[str, ...]) -> Callable[[Column], Column]:
    def sound(x: Column) -> Column:
        out = _is(x, "$", "OBJECT")
        for field in fields:
            out &= _is(x, f"$.{field}", "STRING")
        return out

    return sound


def _sound_element(e: Column) -> Column:
    """An element whose own fields have the right JSON kinds. Other fields, and all fields
    of unknown event types, may hold anything."""
    kind = F.try_variant_get(e, "$.event_type", "string")
    ok = F.lit(True)
    for name, (texts, lists) in _OWN.items():
        own = _is(e, "$", "OBJECT")
        for field in texts:
            own &= _is(e, f"$.{field}", "STRING")
        for field, inner in lists.items():
            items = F.try_variant_get(e, f"$.{field}", "array<variant>")
            own &= _is(e, f"$.{field}", "ARRAY") & F.coalesce(F.forall(items, _entry_test(inner)), F.lit(True))
        ok = F.when(kind == name, own).otherwise(ok)
    return _is(e, "$", "OBJECT") & _is(e, "$.event_type", "STRING") & ok


def _element(e: Column) -> Column:
    """A sound element with the fields of its own type only."""
    kind = F.try_variant_get(e, "$.event_type", "string")

    def text(field: str) -> Column:
        types = [n for n, (texts, _) in _OWN.items() if field in texts]
        return F.when(kind.isin(*types), F.try_variant_get(e, f"$.{field}", "string")).alias(field)

    def items(field: str, inner: tuple[str, ...]) -> Column:
        types = [n for n, (_, lists) in _OWN.items() if field in lists]
        parts = F.transform(
            F.try_variant_get(e, f"$.{field}", "array<variant>"),
            lambda x: F.struct(*[F.try_variant_get(x, f"$.{f}", "string").alias(f) for f in inner]),
        )
        return F.when(kind.isin(*types), parts).alias(field)

    entry = ("asset_id", "price", "size", "side", "best_bid", "best_ask")
    return F.struct(
        kind.alias("event_type"), text("market"), text("asset_id"), items("bids", _LEVEL), items("asks", _LEVEL),
        text("last_trade_price"), items("price_changes", entry), text("price"), text("size"), text("side"),
        text("old_tick_size"), text("new_tick_size"), text("timestamp"),
    )


def _as_struct(ddl: str) -> str:
    """``"a int, b string"`` to ``"a:int,b:string"``."""
    return ",".join(part.replace(" ", ":", 1) for part in ddl.split(", "))


def decode_frames(frames: DataFrame, frame: str = "frame") -> tuple[DataFrame, DataFrame]:
    """``(elements, rejected)``: one row per element of a sound frame with its
    position, and the frames that could not be decoded. Blank frames are in neither."""
    filled = filter_heartbeats(frames, frame).filter(F.length(F.regexp_replace(frame, r"\s", "")) > 0)
    filled = filled.withColumn("_text", F.regexp_replace(frame, r"^\s+|\s+$", ""))
    is_array = F.col("_text").startswith("[")
    body = F.when(is_array, F.col("_text")).otherwise(F.concat(F.lit("["), F.col("_text"), F.lit("]")))
    filled = filled.withColumn("_body", F.concat(F.lit('{"e":'), body, F.lit("}")))
    parsed = once(filled, "_doc", _decoded(F.col("_body")))
    plain = F.coalesce(
        F.col("_doc._bad").isNull() & F.col("_doc.e").isNotNull() & ~F.col("_text").rlike(_MISTYPED), F.lit(False)
    )
    # Only frames the fixed layout does not fit, for whatever field, take the second look.
    parts = F.try_variant_get(F.try_parse_json("_body"), "$.e", "array<variant>")
    second = F.when(F.forall(parts, _sound_element), F.transform(parts, _element))
    checked = once(parsed, "_e", F.when(plain, F.col("_doc.e")).otherwise(second))
    checked = checked.withColumn("_ok", F.col("_e").isNotNull() & (is_array | (F.size("_e") == 1)))
    rest = [c for c in frames.columns if c != frame]
    elements = checked.filter("_ok").select(*rest, F.posexplode("_e").alias("pos", "e"))
    return elements, checked.filter(~F.col("_ok")).select(*frames.columns)


def _event(elements: DataFrame, kind: str, fields: dict[str, Column], e: str = "e") -> DataFrame:
    zero, empty = F.lit(0.0), F.lit("")
    rest = [c for c in elements.columns if c not in ("e", "pos", "_c", "sub", "recv_ts")]
    values = {
        "asset_id": F.coalesce(f"{e}.asset_id", empty),
        **{n: zero for n in _NUMBERS}, "side": empty, **fields,
    }
    if "sub" not in elements.columns:
        elements = elements.withColumn("sub", F.lit(0))
    return elements.select(
        *rest, "pos", "sub",
        F.lit(RECORD_VERSION).alias("v"), F.lit(FEED_SOURCE).alias("src"), F.lit(kind).alias("kind"),
        values["asset_id"].alias("asset_id"), F.coalesce("e.market", empty).alias("market_id"),
        values["price"].alias("price"), values["best_bid"].alias("best_bid"),
        values["best_ask"].alias("best_ask"), values["size"].alias("size"),
        F.coalesce(values["side"], empty).alias("side"),
        values["old_tick_size"].alias("old_tick_size"), values["new_tick_size"].alias("new_tick_size"),
        int_or_zero("e.timestamp").alias("src_ts"), F.col("recv_ts").cast("bigint").alias("recv_ts"),
    )


#: Bits of an event's order number for its place inside a frame: element, then entry.
POS_BITS, SUB_BITS = 10, 10
INSIDE_BITS = POS_BITS + SUB_BITS


def ordered(events: DataFrame, offset: str = "offset") -> DataFrame:
    """Events with ``ord``, their order among events of the same millisecond.

    An asset's frames arrive in one partition of the feed, so the frame's ``offset``
    orders them; ``pos`` and ``sub`` order the events of a frame. A place that does not
    fit into its bits is an error, not a wrong order.
    """
    def fits(name: str, bits: int) -> Column:
        value = F.col(name).cast("bigint")
        message = F.concat(F.lit(f"{name} of an event is out of range: "), value.cast("string"))
        ok = (value >= 0) & (value < F.lit(1 << bits))
        return F.when(ok, value).otherwise(F.raise_error(message).cast("bigint"))

    number = F.shiftleft(fits(offset, 62 - INSIDE_BITS), INSIDE_BITS) + F.shiftleft(fits("pos", POS_BITS), SUB_BITS)
    return events.withColumn("ord", number + fits("sub", SUB_BITS))


def parse_book(elements: DataFrame) -> DataFrame:
    """Best bid and ask over unsorted levels; price = last trade, else the mid."""
    def prices(levels: str) -> Column:
        return F.transform(F.col(levels), lambda x: num_or_zero(x["price"]))

    books = elements.filter(F.col("e.event_type") == "book")
    bid = F.coalesce(F.array_max(prices("e.bids")), F.lit(0.0))
    ask = F.coalesce(F.array_min(prices("e.asks")), F.lit(0.0))
    trade = num_or_zero("e.last_trade_price")
    price = F.when((trade == 0) & (bid > 0) & (ask > 0), mid_price(bid, ask)).otherwise(trade)
    return _event(books, "book", {"best_bid": bid, "best_ask": ask, "price": price})


def parse_price_change(elements: DataFrame) -> DataFrame:
    """One quote per entry of the message."""
    changes = elements.filter(F.col("e.event_type") == "price_change")
    entries = changes.select(
        *changes.columns, F.posexplode("e.price_changes").alias("sub", "_c")
    )
    fields = {n: num_or_zero(f"_c.{n}") for n in ("price", "best_bid", "best_ask", "size")}
    return _event(entries, "quote", {**fields, "side": F.col("_c.side")}, e="_c")


def parse_last_trade(elements: DataFrame) -> DataFrame:
    trades = elements.filter(F.col("e.event_type") == "last_trade_price")
    return _event(trades, "trade", {
        "price": num_or_zero("e.price"), "size": num_or_zero("e.size"), "side": F.col("e.side"),
    })


def parse_tick_size_change(elements: DataFrame) -> DataFrame:
    rows = elements.filter(F.col("e.event_type") == "tick_size_change")
    return _event(rows, "tick_size_change", {
        "old_tick_size": num_or_zero("e.old_tick_size"), "new_tick_size": num_or_zero("e.new_tick_size"),
    })


def unknown_types(elements: DataFrame) -> DataFrame:
    """Elements outside the four known event types (skipped by the parsers)."""
    return elements.filter(~F.coalesce(F.col("e.event_type").isin(*EVENT_TYPES), F.lit(False)))


def parse_frames(frames: DataFrame, frame: str = "frame") -> DataFrame:
    """All events of all sound frames.

    ``pos`` and ``sub`` give the order inside the frame. One scan: each element
    becomes an array of event structs, by type, and is exploded once.
    """
    elements, _ = decode_frames(frames, frame)
    e = F.col("e")
    kind = e["event_type"]
    none = F.lit("")

    def event(name: str, asset: Column, side: Column, **numbers: Column) -> Column:
        return F.struct(
            F.lit(name).alias("kind"), F.coalesce(asset, none).alias("asset_id"),
            *[F.coalesce(numbers[n], F.lit(0.0)).alias(n) if n in numbers else F.lit(0.0).alias(n)
              for n in _NUMBERS],
            F.coalesce(side, none).alias("side"),
        )

    def prices(levels: Column) -> Column:
        return F.transform(levels, lambda x: num_or_zero(x["price"]))

    bid = F.coalesce(F.array_max(prices(e["bids"])), F.lit(0.0))
    ask = F.coalesce(F.array_min(prices(e["asks"])), F.lit(0.0))
    traded = num_or_zero(e["last_trade_price"])
    book_price = F.when((traded == 0) & (bid > 0) & (ask > 0), mid_price(bid, ask)).otherwise(traded)
    events = (
        F.when(kind == "book", F.array(
            event("book", e["asset_id"], none, price=book_price, best_bid=bid, best_ask=ask)))
        .when(kind == "price_change", F.transform(e["price_changes"], lambda c: event(
            "quote", c["asset_id"], c["side"], price=num_or_zero(c["price"]),
            best_bid=num_or_zero(c["best_bid"]), best_ask=num_or_zero(c["best_ask"]),
            size=num_or_zero(c["size"]))))
        .when(kind == "last_trade_price", F.array(event(
            "trade", e["asset_id"], e["side"], price=num_or_zero(e["price"]), size=num_or_zero(e["size"]))))
        .when(kind == "tick_size_change", F.array(event(
            "tick_size_change", e["asset_id"], none,
            old_tick_size=num_or_zero(e["old_tick_size"]), new_tick_size=num_or_zero(e["new_tick_size"]))))
    )
    rest = [c for c in elements.columns if c not in ("e", "recv_ts")]
    return (
        elements.filter(kind.isin(*EVENT_TYPES))
        .select(*rest, "recv_ts", e["market"].alias("_m"), e["timestamp"].alias("_t"),
                F.posexplode(events).alias("sub", "x"))
        .select(
            *rest, "sub", F.lit(RECORD_VERSION).alias("v"), F.lit(FEED_SOURCE).alias("src"),
            F.col("x.kind").alias("kind"), F.col("x.asset_id").alias("asset_id"),
            F.coalesce("_m", none).alias("market_id"),
            *[F.col(f"x.{n}").alias(n) for n in ("price", "best_bid", "best_ask", "size", "side",
                                                "old_tick_size", "new_tick_size")],
            int_or_zero("_t").alias("src_ts"), F.col("recv_ts").cast("bigint").alias("recv_ts"),
        )
    )
