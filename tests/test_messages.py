from __future__ import annotations

import json

from helpers import message, messages, payload, trade, trades
from tickbars import operators as op
from tickbars.schemas import TRADE
from tickbars.streaming import decoded_stream

GOOD = payload(trade(1, "10:00:00"))


def offsets(df):
    return sorted(r.offset for r in df.collect())


def test_headers(spark):
    ok = ("eventType", "MARKET_RECORD")
    cases = [
        ([ok], True),
        ([], False),
        (None, False),
        ([("eventType", None)], False),
        ([("eventType", "OTHER")], False),
        ([("eventType", "OTHER"), ok], True),
        ([("eventtype", "MARKET_RECORD")], False),
        ([("eventType", None), ok], True),
        ([("eventType", "SECOND")], True),
    ]
    df = messages(spark, [message(GOOD, i, h) for i, (h, _) in enumerate(cases)])
    want = [i for i, (_, keep) in enumerate(cases) if keep]
    assert offsets(op.filter_events(df, ["MARKET_RECORD", "SECOND"])) == want
    assert offsets(op.filter_events(df, [])) == []


def test_payloads(spark):
    base = json.loads(GOOD)
    cases = [
        (GOOD, None),
        (json.dumps({**base, "extra": {"a": [1]}}), None),
        (json.dumps({**base, "price": "10.5"}), None),
        (json.dumps({**base, "quantity": 3.0}), None),
        ("{bad", "malformed"),
        ("[1]", "malformed"),
        ("", "malformed"),
        (None, "malformed"),
        (GOOD[:-1], "malformed"),
        (GOOD + GOOD, "malformed"),
        (f"{GOOD},{GOOD}", "malformed"),
        (GOOD + " x", "malformed"),
        (json.dumps({**base, "tradeNo": 100.7}), "tradeNo"),
        (json.dumps({**base, "value": None}), None),
        (json.dumps({**base, "price": "abc"}), "price"),
        (json.dumps({**base, "quantity": "x"}), "quantity"),
        (json.dumps({**base, "price": None}), "price"),
        (json.dumps({k: v for k, v in base.items() if k != "secId"}), "secId"),
        (json.dumps({**base, "tradeDate": "31.02.2021"}), "time"),
        ("null", "dropped"),
        (" null\n", "dropped"),
    ]
    df = decoded_stream(messages(spark, [message(v, i) for i, (v, _) in enumerate(cases)]))
    bad = {r.offset: r.problem for r in op.invalid_trades(df).collect()}
    assert bad == {i: p for i, (_, p) in enumerate(cases) if p not in (None, "dropped")}
    good = {r.offset: r for r in op.valid_trades(df).collect()}
    assert set(good) == {i for i, (_, p) in enumerate(cases) if p is None}
    assert good[2].price == 10.5 and good[3].quantity == 3


def test_roundtrip_with_nulls(spark):
    rows = [trade(1, "10:00:00", 0.1 + 0.2), trade(2, None, None, None, None, None, None)]
    df = op.to_messages(trades(spark, rows), topic="t")
    assert set(df.columns) == {"key", "value", "headers", "topic"}
    first = df.orderBy("value").first()
    assert first.key is None and first.headers[0].key == "eventType"
    assert bytes(first.headers[0].value) == b"MARKET_RECORD"
    assert all(set(json.loads(bytes(r.value))) == set(TRADE.names) for r in df.collect())
    back = op.decode_trades(df).select(*TRADE.names)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_offset_ranges(spark):
    rows = [message(GOOD, o, partition=p, topic=t) for t, p, o in [("a", 0, 5), ("a", 0, 7), ("a", 1, 2), ("b", 0, 0)]]
    got = {(r.topic, r.partition): (r.from_offset, r.until_offset, r.n) for r in op.offset_ranges(messages(spark, rows)).collect()}
    assert got == {("a", 0): (5, 8, 2), ("a", 1): (2, 3, 1), ("b", 0): (0, 1, 1)}
