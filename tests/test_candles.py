import random
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import START, trade
from tradeflow.operators.candles import (
    candle_report,
    candles,
    fill_gaps,
    gap_spans,
    roll_up,
    tick_candles,
    ticker_spans,
)
from tradeflow.operators.health import arrivals, health
from tradeflow.operators.latest import latest, messages, newest_requests


def _rows(count=400, seconds=7200):
    rng = random.Random(8)
    return [
        trade(i, rng.randrange(seconds * 4) / 4, rng.randrange(1, 40000) / 100,
              rng.choice(["A", "B", "B", "B"]), rng.randrange(1, 100))
        for i in range(count)
    ]


def _brute(rows, seconds):
    groups = defaultdict(list)
    for row in rows:
        at = int((row[0] - START).total_seconds() // seconds)
        groups[row[2], START + timedelta(seconds=at * seconds)].append(row)
    out = {}
    for key, found in groups.items():
        found.sort(key=lambda r: (r[0], r[1]))
        prices = [r[3] for r in found]
        cents = sum(round(r[3] * 100) * r[4] for r in found)
        out[key] = (prices[0], max(prices), min(prices), prices[-1],
                    sum(r[4] for r in found), len(found), cents / 100)
    return out


def _shown(df):
    return {
        (r["ticker"], r["bucket_start"]): (
            r["open"], r["high"], r["low"], r["close"], r["volume"], r["trades"], r["notional"]
        )
        for r in candle_report(df).collect()
    }


@pytest.mark.parametrize("width,seconds", [("1 minute", 60), ("1 hour", 3600), ("5 seconds", 5)])
def test_candles_against_brute_force(make, width, seconds):
    rows = _rows()
    assert _shown(candles(make(rows).repartition(5), width)) == _brute(rows, seconds)


def test_roll_up_is_direct_aggregation(make):
    rows = _rows(800, 3 * 86400)
    fine = candles(make(rows).repartition(5), "1 minute")
    day = roll_up(roll_up(fine, "1 hour"), "1 day")
    assert _shown(day) == _brute(rows, 86400)


def test_ties_in_time_are_broken_by_id(make):
    rows = [trade(2, 5, 20.0), trade(1, 5, 10.0), trade(3, 5, 30.0)]
    row = candles(make(rows), "1 minute").first()
    assert (row["open"], row["close"]) == (10.0, 30.0)
    assert latest(make(rows)).first()["price"] == 30.0


def test_high_low_ticks_need_no_sort(make):
    plan = tick_candles(make(_rows()), "7 seconds")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("width,seconds", [("7 seconds", 7), ("1 minute", 60), ("1 hour", 3600)])
def test_gaps_cover_every_bucket_once(make, width, seconds):
    # A width that does not divide a day, over more than two days.
    rows = [trade(1, 3), trade(2, 200_000), trade(3, 30, ticker="B"), trade(4, 31, ticker="B")]
    df = make(rows)
    filled = fill_gaps(tick_candles(df, width), width, ticker_spans(df, width))
    counts = {
        r["ticker"]: (r["n"], r["d"], r["with"])
        for r in filled.groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.countDistinct("bucket_start").alias("d"),
            F.count("trades").alias("with"),
        )
        .collect()
    }
    epoch = int(START.timestamp())
    buckets = (epoch + 200_000) // seconds - (epoch + 3) // seconds + 1
    assert counts["AAPL"] == (buckets, buckets, 2)
    few = (epoch + 31) // seconds - (epoch + 30) // seconds + 1
    assert counts["B"][:2] == (few, few)


def test_messages_for_known_and_unknown_tickers(spark, make):
    subs = spark.createDataFrame(
        [("s1", "AAPL", 5, START), ("s2", "NONE", 9, START),
         ("s3", "NONE", 1, START), ("s3", "AAPL", 2, START + timedelta(seconds=1))],
        "sub_id string, ticker string, tick int, updated_at timestamp",
    )
    assert newest_requests(subs).where("sub_id = 's3'").first()["ticker"] == "AAPL"
    sent = {r["sub_id"]: r for r in messages(subs, latest(make([trade(1, 0, 12.5)]))).collect()}
    assert sent["s1"]["data"].asDict() == {"high": 12.5, "low": 12.5}
    assert sent["s2"]["data"] is None and sent["s2"]["current_tick"] == 9
    assert (sent["s3"]["type"], sent["s3"]["current_tick"]) == ("candle_tick", 2)


def test_health_tells_silence_from_delay_and_failure(make):
    rows = [trade(1, 59), trade(2, 190), trade(3, 299)]
    bad = [trade(9, 100), trade(10, 101), trade(11, 20)]
    found = health(
        arrivals(make(rows), "1 minute"), "1 minute", rejected=make(bad), slow="30 seconds"
    )
    shown = [(r["rows"], r["rejected"], r["status"]) for r in found.orderBy("bucket_start").collect()]
    assert shown == [
        (1, 1, "ok"),
        (0, 2, "failed"),
        (0, 0, "none"),
        (1, 0, "delayed"),
        (1, 0, "ok"),
    ]


def test_roll_up_refuses_a_width_that_does_not_fit(make):
    fine = candles(make([trade(0, 1)]), "1 minute")
    with pytest.raises(ValueError):
        roll_up(fine, "90 seconds", "1 minute")
    assert roll_up(fine, "1 hour", "1 minute").count() == 1


def test_gap_spans_expand_to_the_empty_buckets_of_fill_gaps(spark, make):
    rng = random.Random(11)
    rows = [trade(k, rng.choice([0, 1, 2, 5, 6, 30, 31, 33]) * 600 + rng.randrange(600), ticker="A") for k in range(60)]
    rows += [trade(100 + k, s * 600, ticker=None) for k, s in enumerate([0, 7, 8, 20])]
    rows += [trade(200, 4000, ticker="ONE"), trade(201, 4100, ticker="ONE")]
    trades = make(rows)
    found = tick_candles(trades, "10 minutes")
    for chunk in ("1 hour", "1 day"):
        spans = gap_spans(found, "10 minutes", chunk)
        expanded = spans.select(
            "ticker", F.explode(F.sequence("gap_start", "gap_end", F.expr("INTERVAL 10 MINUTES"))).alias("b")
        )
        filled = fill_gaps(found, "10 minutes", ticker_spans(trades, "10 minutes"))
        empty = filled.where(F.col("trades").isNull()).select("ticker", "bucket_start")
        def rows(df):
            return sorted((r[0], r[1]) for r in df.where(F.col("ticker").isNotNull()).collect())

        assert rows(expanded) == rows(empty)
        sizes = {(r["ticker"], r["buckets"]) for r in spans.collect()}
        assert ("A", 23) in sizes and not [s for s in sizes if s[0] == "ONE"]
        assert sorted(s for t, s in sizes if t is None) == [6, 11]
