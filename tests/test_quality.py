import pytest

from conftest import trade
from tradeflow.operators.quality import (
    check_requests,
    check_subscriptions,
    normalize_trades,
    validate_trades,
)

CASES = [
    ({}, None),
    ({"price": 0.0}, "price"),
    ({"price": 0.001}, None),
    ({"price": 0.01}, None),
    ({"price": 10000.0}, None),
    ({"price": 10000.01}, "price"),
    ({"price": None}, "price"),
    ({"price": float("nan")}, "price"),
    ({"volume": 0}, "volume"),
    ({"volume": 1}, None),
    ({"volume": 1000000}, None),
    ({"volume": 1000001}, "volume"),
    ({"ticker": ""}, "ticker"),
    ({"ticker": "aapl"}, None),
    ({"ticker": "A" * 10}, None),
    ({"ticker": "A" * 11}, "ticker"),
    ({"currency_code": "usd"}, None),
    ({"currency_code": "US"}, "currency_code"),
    ({"trade_type": "buy"}, "trade_type"),
    ({"trade_type": "HOLD"}, "trade_type"),
    ({"event_id": "not-a-uuid"}, "event_id"),
    ({"trade_id": None}, "trade_id"),
    ({"market_code": "M" * 20}, None),
    ({"market_code": "M" * 21}, "market_code"),
    ({"event_time": None}, "event_time"),
]


def test_each_rule_at_and_beyond_its_bound(make):
    rows = [trade(i, i, **{"trade_id": trade(i, 0)[6], **case}) for i, (case, _) in enumerate(CASES)]
    valid, rejected = validate_trades(make(rows))
    reasons = {tuple(r)[:9]: r["violations"] for r in rejected.collect()}
    assert valid.count() + len(reasons) == len(CASES)
    expected = sorted(name for _, name in CASES if name)
    assert sorted(v for found in reasons.values() for v in found) == expected


def test_a_row_lists_all_its_violations(make):
    _, rejected = validate_trades(make([trade(1, 0, price=0.0, volume=0, currency_code="X")]))
    assert rejected.first()["violations"] == ["price", "volume", "currency_code"]


def test_ids_need_not_be_uuids_when_switched_off(make):
    rows = make([trade(1, 0, event_id="7"), trade(2, 0, event_id=None)])
    valid, rejected = validate_trades(rows, uuids=False)
    assert (valid.count(), rejected.count()) == (1, 1)


def test_bounds_apply_before_rounding(make):
    valid, _ = validate_trades(make([trade(1, 0, price=0.001, ticker="aapl", currency_code="usd")]))
    row = normalize_trades(valid).first()
    assert (str(row["price"]), row["ticker"], row["currency_code"]) == ("0.00", "AAPL", "USD")


def test_requests(spark):
    rows = [
        (1, None, None, None, None),
        (2, 0, None, None, None),
        (3, 1, "AAPL", "buy", "NYSE"),
        (4, 1, "aapl", "Sell", "ny"),
        (5, 1, "A1", "hold", ""),
        (6, 1, "AAPL\n", None, None),
    ]
    schema = "request_id int, duration int, ticker string, tradeType string, marketCode string"
    found = check_requests(spark.createDataFrame(rows, schema)).orderBy("request_id").collect()
    assert [r["violations"] for r in found] == [
        [],
        ["duration"],
        [],
        ["ticker", "market_code"],
        ["ticker", "trade_type", "market_code"],
        ["ticker"],
    ]
    assert found[2]["trade_type"] == "BUY"


def test_unknown_request_parameter(spark):
    with pytest.raises(ValueError):
        check_requests(spark.createDataFrame([(1, 2)], "request_id int, price int"))


def test_subscriptions(spark):
    rows = [("a", "x", 0), ("b", "x", 1), ("c", "X", 60), ("d", "X", 61), ("e", "", 5), ("f", "X" * 11, 5)]
    found = check_subscriptions(spark.createDataFrame(rows, "sub_id string, ticker string, tick int"))
    bad = {r["sub_id"]: r["violations"] for r in found.collect() if r["violations"]}
    assert bad == {"a": ["tick"], "d": ["tick"], "e": ["ticker"], "f": ["ticker"]}


def test_bounds_of_valid_trades_reach_the_scan(spark, make, tmp_path):
    path = str(tmp_path / "raw")
    make([trade(1, 0), trade(2, 0, price=0.0)]).write.parquet(path)
    valid, rejected = validate_trades(spark.read.parquet(path))
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert "(price#" in plan.split("DataFilters", 1)[1]
    assert (valid.count(), rejected.count()) == (1, 1)
