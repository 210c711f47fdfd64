"""Record layouts as Spark DDL. Ids are opaque strings, prices are doubles."""
from __future__ import annotations

RAW_EVENT = (
    "v int, src string, kind string, asset_id string, market_id string, price double, "
    "best_bid double, best_ask double, size double, side string, old_tick_size double, "
    "new_tick_size double, src_ts bigint, recv_ts bigint"
)
TICK = (
    "v int, a string, m string, p double, b double, k double, c1m double, c5m double, "
    "vol double, seq bigint, rts bigint, pts bigint"
)
ALERT = (
    "v int, a string, m string, q string, outcome string, `from` double, `to` double, "
    "window_s int, ts bigint"
)
MARKET = (
    "v int, market_id string, question string, slug string, end_date string, category string, "
    "tags array<string>, volume double, active boolean, closed boolean, "
    "outcomes array<string>, clob_token_ids array<string>"
)
TOP = "v int, ts bigint, d array<struct<a:string,c5m:double>>"
MARKET_PAGE = (
    "id string, conditionId string, question string, slug string, endDate string, "
    "volumeNum double, active boolean, closed boolean, outcomes string, clobTokenIds string"
)
LEVELS = "array<struct<price:string,size:string>>"
FRAME = (
    f"event_type string, market string, asset_id string, bids {LEVELS}, asks {LEVELS}, "
    "last_trade_price string, price_changes array<struct<asset_id:string,price:string,"
    "size:string,side:string,best_bid:string,best_ask:string>>, price string, size string, "
    "side string, old_tick_size string, new_tick_size string, timestamp string"
)
CLIENT_MESSAGE = "op string, ch string, ids array<string>, t bigint"
MANIFEST = (
    "recorded_at string, duration_s bigint, files array<string>, markets string, benchmark string"
)

# Fixed values of the wire contract.
RECORD_VERSION = 1
PROTO_VERSION = 1
FEED_SOURCE = "polymarket"
KINDS = ("quote", "trade", "book", "tick_size_change")
EVENT_TYPES = ("book", "price_change", "last_trade_price", "tick_size_change")
CHANNELS = ("asset", "top", "alerts", "sys")

# Retention of each record stream, milliseconds.
RETENTION_MS = {
    "raw": 6 * 3_600_000,
    "ticks": 24 * 3_600_000,
    "alerts": 7 * 24 * 3_600_000,
    "top": 3_600_000,
}
