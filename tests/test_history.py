import random
from datetime import datetime, timedelta

import pytest

from conftest import START, trade
from tradeflow.operators.history import (
    HistoryQuery,
    TimeRange,
    history,
    history_page,
    matching,
    newest,
    next_cursor,
    summary,
)
from tradeflow.sources import append_trades, read_trades


@pytest.mark.parametrize(
    "params",
    [
        {"duration": 0},
        {"duration": "x"},
        {"duration": 1.5},
        {"ticker": "aapl"},
        {"ticker": "A1"},
        {"ticker": ""},
        {"marketCode": "nyse"},
        {"tradeType": "hold"},
        {"trade_type": "BUY"},
        {"price": 1},
    ],
)
def test_bad_parameters(params):
    with pytest.raises(ValueError):
        HistoryQuery.from_params(params)


def test_good_parameters():
    query = HistoryQuery.from_params({"duration": "5", "tradeType": "sell", "ticker": "AAPL"})
    assert query == HistoryQuery(5, "AAPL", "SELL", None)


def test_range_policy():
    with pytest.raises(ValueError):
        TimeRange(START, START)
    with pytest.raises(ValueError):
        TimeRange(START, START + timedelta(days=31))


def test_lookback_is_inclusive_and_has_no_upper_end(make):
    as_of = START + timedelta(minutes=10)
    rows = make([trade(1, 299.999999), trade(2, 300), trade(3, 600), trade(4, 900)])
    found = matching(rows, HistoryQuery(duration=5), as_of)
    ids = sorted(r["event_id"][:8] for r in found.collect())
    assert ids == ["00000002", "00000003", "00000004"]
    assert history(rows, HistoryQuery(duration=5), as_of).first()["event_id"].startswith("00000004")


def test_lookback_from_now(make):
    old = trade(1, 0)
    fresh = trade(2, 0, event_time=datetime.now() + timedelta(seconds=5))
    assert matching(make([old, fresh]), HistoryQuery(duration=1)).count() == 1


def test_range_is_half_open(make):
    rows = make([trade(1, 0), trade(2, 59.9), trade(3, 60)])
    span = TimeRange(START, START + timedelta(minutes=1))
    assert matching(rows, span=span).count() == 2


def _random_trades(count: int):
    rng = random.Random(3)
    # Few distinct times: many ties.
    return [
        trade(i, rng.randrange(50), price=rng.randrange(1, 900) / 4, ticker=rng.choice("AAB"))
        for i in range(count)
    ]


def test_pages_together_are_the_whole_answer(make):
    rows = _random_trades(230)
    df = make(rows).repartition(4).cache()
    cursor, pages = None, []
    for _ in range(10):
        page = history_page(df, HistoryQuery(ticker="A"), cursor, size=40)
        pages += [(r["event_time"], r["event_id"]) for r in page.collect()]
        cursor = next_cursor(page, 40)
        if cursor is None:
            break
    wanted = sorted(((r[0], r[1]) for r in rows if r[2] == "A"), reverse=True)
    assert pages == wanted


@pytest.mark.parametrize("lanes", [1, 2, 7])
def test_newest_is_the_same_with_any_number_of_lanes(make, lanes):
    rows = _random_trades(500)
    found = newest(make(rows).repartition(9), 100, lanes).collect()
    wanted = sorted(((r[0], r[1]) for r in rows), reverse=True)[:100]
    assert [(r["event_time"], r["event_id"]) for r in found] == wanted


@pytest.mark.parametrize("limit", [1, 3, 4, 7, 100])
def test_newest_days_hold_the_newest_rows(spark, make, tmp_path, limit):
    path = str(tmp_path / "trades")
    rows = [trade(i, 86400 * (i % 4) + i, ticker="AB"[i % 3 == 0]) for i in range(12)]
    append_trades(make(rows), path)
    found = newest(matching(read_trades(spark, path), HistoryQuery(ticker="A")), limit, by_day=True)
    wanted = sorted(((r[0], r[1]) for r in rows if r[2] == "A"), reverse=True)[:limit]
    assert [(r["event_time"], r["event_id"]) for r in found.collect()] == wanted
    if limit == 1:
        assert "event_date#" in _plan(found).split("PartitionFilters", 1)[1].split("\n")[0]


def test_summary_counts_page_and_match(make):
    row = summary(make(_random_trades(120)), HistoryQuery(trade_type="buy"), limit=50).first()
    assert (row["count"], row["total_count"]) == (50, 120)
    assert row["filters"].asDict() == {
        "duration": None,
        "ticker": None,
        "trade_type": "BUY",
        "market_code": None,
    }


def test_summary_of_nothing(make):
    row = summary(make(_random_trades(5)), HistoryQuery(ticker="ZZZ")).first()
    assert (row["count"], row["total_count"], row["first_time"]) == (0, 0, None)


def _plan(df) -> str:
    python = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return python.explainString(df._jdf.queryExecution(), "formatted")


def test_stored_table_reads_only_the_days_it_needs(spark, make, tmp_path):
    path = str(tmp_path / "trades")
    days = [trade(i, 86400 * i + 3600) for i in range(5)]
    assert append_trades(make(days), path) == 5
    table = read_trades(spark, path)
    as_of = START + timedelta(days=4, hours=2)
    found = history(table, HistoryQuery(duration=24 * 60, ticker="AAPL"), as_of)
    plan = _plan(found)
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "GreaterThanOrEqual(event_time" in plan and "EqualTo(ticker,AAPL)" in plan
    assert "TakeOrderedAndProject" in plan
    assert found.count() == 1
    span = TimeRange(START + timedelta(days=1), START + timedelta(days=3))
    assert matching(table, span=span).count() == 2


@pytest.mark.parametrize("limit", [3, 6, 9, 20])
def test_newest_days_lose_no_rows_without_time(spark, make, tmp_path, limit):
    path = str(tmp_path / "trades")
    rows = [trade(i, 86400 * i) for i in range(5)]
    rows += [trade(i, 0, event_time=None) for i in range(5, 10)]
    append_trades(make(rows), path)
    stored = read_trades(spark, path)
    by_day = newest(stored, limit, by_day=True).collect()
    assert by_day == newest(stored, limit).collect() and len(by_day) == min(limit, 10)
