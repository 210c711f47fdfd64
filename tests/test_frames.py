import json

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.functions import numbers, text, wire
from tickloom.sources import frames, markets, recording, topics

TRADE = {
    "market": "0xefa1", "asset_id": "333", "price": "0.002", "size": "5", "fee_rate_bps": "0", "side": "BUY",
    "timestamp": "1790491136979", "event_type": "last_trade_price", "transaction_hash": "0x22",
}
BOOK = {
    "event_type": "book", "market": "m", "asset_id": "a", "timestamp": "5",
    "bids": [{"price": ".85", "size": "1"}, {"price": ".87", "size": "2"}, {"price": ".1", "size": "2"}],
    "asks": [{"price": ".9", "size": "1"}, {"price": ".88", "size": "3"}],
}


def parse(spark, *texts):
    rows = spark.createDataFrame([(t, 1000 + i) for i, t in enumerate(texts)], "frame string, recv_ts bigint")
    return frames.parse_frames(rows).orderBy("recv_ts", "pos", "sub").collect()


def test_trade(spark):
    (row,) = parse(spark, json.dumps(TRADE))
    assert (row.kind, row.price, row.size, row.side, row.src_ts) == ("trade", 0.002, 5.0, "BUY", 1790491136979)


def test_book_uses_best_levels_and_trade_price_or_mid(spark):
    (mid,) = parse(spark, json.dumps(BOOK))
    assert (mid.best_bid, mid.best_ask, mid.price) == (0.87, 0.88, 0.875)
    (traded,) = parse(spark, json.dumps([{**BOOK, "last_trade_price": ".870"}]))
    assert traded.price == 0.87
    (one_sided,) = parse(spark, json.dumps({**BOOK, "asks": []}))
    assert (one_sided.price, one_sided.best_ask) == (0.0, 0.0)


def test_price_change_and_tick_size(spark):
    change = {
        "event_type": "price_change", "market": "m", "timestamp": "7", "price_changes": [
            {"asset_id": "a", "price": "0.5", "size": "1", "side": "SELL", "best_bid": "0.4", "best_ask": "0.6"},
            {"asset_id": "b", "price": "x", "size": "", "side": "BUY"}]}
    size = {"event_type": "tick_size_change", "asset_id": "z", "market": "m", "old_tick_size": "0.01",
            "new_tick_size": "0.001", "timestamp": "100000000"}
    rows = parse(spark, json.dumps([change, size]))
    assert [(r.kind, r.asset_id, r.price) for r in rows] == [
        ("quote", "a", 0.5), ("quote", "b", 0.0), ("tick_size_change", "z", 0.0)]
    assert (rows[2].old_tick_size, rows[2].new_tick_size) == (0.01, 0.001)


@pytest.mark.parametrize("bad", [
    "not json", "[1", json.dumps(TRADE) + " x", json.dumps([TRADE, 5]), json.dumps({**TRADE, "price": 0.5}),
    json.dumps({**BOOK, "bids": "oops"}), json.dumps(TRADE) + "," + json.dumps(TRADE),
])
def test_one_bad_element_rejects_the_frame(spark, bad):
    rows = spark.createDataFrame([(bad, 1)], "frame string, recv_ts bigint")
    elements, rejected = frames.decode_frames(rows)
    assert elements.count() == 0 and rejected.count() == 1
    assert parse(spark, bad) == []


def test_blank_heartbeat_and_unknown_types_give_nothing(spark):
    assert parse(spark, "", "  ", "PONG", "[]", "{}", '{"event_type":"new_market","id":3}') == []
    rows = parse(spark, json.dumps([{"event_type": "best_bid_ask"}, TRADE]))
    assert [r.pos for r in rows] == [1]


def test_numbers(spark):
    cases = {"1.5": 1.5, "1.5d": 0, " 1.5": 0, "": 0, "1e400": 0, ".5": 0.5, "5.": 5, "+5": 5, "x": 0, "inf": float("inf")}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", numbers.num_or_zero("t").alias("v"))
    assert {r.t: r.v for r in rows.collect()} == cases
    ints = {"12": 12, "+5": 5, "-3": -3, "1.5": 0, "": 0, "99999999999999999999": 0}
    rows = spark.createDataFrame([(k,) for k in ints], "t string").select("t", numbers.int_or_zero("t").alias("v"))
    assert {r.t: r.v for r in rows.collect()} == ints


PAGE = [
    {"id": "1", "conditionId": "0xaa", "question": "A?", "volumeNum": 1197862.31, "active": True, "closed": False,
     "outcomes": '["Minnesota", "Washington"]', "clobTokenIds": '["11","12"]', "other": 1},
    {"id": "2", "conditionId": "0x69", "question": "B?", "volumeNum": 1521804.87, "active": True, "closed": False,
     "outcomes": '["Yes","No"]', "clobTokenIds": '["21","22"]'},
    {"id": "3", "conditionId": "0xef", "question": "C?", "volumeNum": 22892933.9, "active": True, "closed": False,
     "outcomes": "", "clobTokenIds": '["31","32"]'},
    {"id": "4", "conditionId": "0xdd", "question": "D?", "volumeNum": 9e9, "active": True, "closed": True},
]


def test_markets_catalog(spark, tmp_path):
    (tmp_path / "p1.json").write_text(json.dumps(PAGE[:2]))
    (tmp_path / "p2.json").write_text(json.dumps(PAGE[2:], indent=1))
    from tickloom.operators.catalog import top_n_markets

    rows = markets.read_markets_catalog(spark, str(tmp_path))
    assert [r.market_id for r in top_n_markets(rows, 2).collect()] == ["0xef", "0x69"]
    found = {r.market_id: r for r in rows.collect()}
    assert found["0xaa"].outcomes == ["Minnesota", "Washington"] and found["0xef"].outcomes is None
    assert found["0x69"].clob_token_ids == ["21", "22"]


def test_bad_market_list(spark):
    bad = spark.createDataFrame([{**PAGE[0], "slug": "", "endDate": "", "outcomes": "[1,2]"}], schemas.MARKET_PAGE)
    with pytest.raises(Exception, match="cannot decode outcomes"):
        markets.normalize_markets(bad).collect()
    row = markets.normalize_markets(bad, "permissive").first()
    assert row.error == "outcomes" and row.outcomes is None and row.clob_token_ids == ["11", "12"]


def test_messages(spark):
    one = spark.range(1)
    got = one.select(
        wire.hello("gw").alias("h"), wire.error("too_many_subs", "limit 500").alias("e"),
        wire.pong(F.lit(5), F.lit(9)).alias("p"),
        wire.envelope("ticks", F.array(F.lit('{"a":1}'), F.lit("2"))).alias("t"),
        wire.envelope("snap", F.array().cast("array<string>")).alias("s"),
        wire.envelope_one("top", F.lit("[]")).alias("o"),
    ).first()
    assert got.h == '{"t":"hello","server":"gw","proto":1}'
    assert got.e == '{"t":"err","code":"too_many_subs","msg":"limit 500"}'
    assert got.p == '{"t":"pong","t0":5,"srv":9}'
    assert (got.t, got.s, got.o) == ('{"t":"ticks","d":[{"a":1},2]}', '{"t":"snap","d":[]}', '{"t":"top","d":[]}')


def test_display_text(spark):
    row = spark.range(1).select(
        text.pct(F.lit(0.634)).alias("a"), text.pp(F.lit(3.4)).alias("b"), text.pp(F.lit(-3.4)).alias("c"),
        text.truncate(F.lit("abcdef"), 4).alias("d"), text.truncate(F.lit("abcd"), 4).alias("e"),
        text.surge_line(F.lit("Yes"), F.lit(0.41), F.lit(0.58), F.lit(60)).alias("f"),
    ).first()
    assert tuple(row) == ("63.4%", "+3.4pp", "-3.4pp", "abc…", "abcd", "Yes: 41.0% → 58.0% in 60s")


def test_records_round_trip_and_quarantine(spark, tmp_path):
    raw = spark.createDataFrame([("a", 0.0, 0.5, 7), ("b", 0.25, 0.0, 8)], "asset_id string, price double, size double, src_ts bigint")
    topics.write_topic(raw, str(tmp_path / "t"), "asset_id", omit_zero=topics.RAW_OPTIONAL)
    lines = topics.read_topic_bounded(spark, str(tmp_path / "t"))
    assert sorted(r.value for r in lines.collect()) == [
        '{"asset_id":"a","size":0.5,"src_ts":7}', '{"asset_id":"b","price":0.25,"src_ts":8}']
    mixed = lines.select("value").unionByName(spark.createDataFrame([("{oops",), (None,)], "value string"))
    good, bad = topics.decode_json_records(mixed, schemas.RAW_EVENT)
    assert good.count() == 2 and [r.value for r in bad.collect()] == ["{oops"]
    filled = topics.with_raw_defaults(good).orderBy("asset_id").collect()
    assert [(r.price, r.size) for r in filled] == [(0.0, 0.5), (0.25, 0.0)]


def test_recording_rotates_by_hour_and_appends(spark, tmp_path):
    path = str(tmp_path / "rec")
    at = 1_790_505_000_000  # 10:30 UTC
    rows = [("tick", json.dumps({"a": "x", "pts": at})), ("alert", json.dumps({"a": "x", "ts": at + 35 * 60_000}))]
    recording.write_recording(spark.createDataFrame(rows, "t string, d string"), path)
    recording.write_recording(spark.createDataFrame(rows[:1], "t string, d string"), path)
    got = recording.read_recording(spark, path)
    by_hour = {(r.kind, int(r.hour)): r["count"] for r in got.groupBy("kind", "hour").count().collect()}
    hours = sorted(h for _, h in by_hour)
    assert sorted(by_hour.values()) == [1, 2] and hours[1] - hours[0] == 1
    assert got.filter("kind = 'alert'").first().ts == at + 35 * 60_000
