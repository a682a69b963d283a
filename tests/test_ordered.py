import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import trade
from tradeflow.operators import anomaly, ordered
from tradeflow.operators.ordered import over_preceding


def _skewed(count=6000):
    """One ticker has most rows, and one instant of it a third of all."""
    rng = random.Random(1)
    rows = []
    for i in range(count):
        ticker = rng.choice("HHHHHHABC")
        seconds = 500 if rng.random() < 0.33 else rng.randrange(100000) / 10
        price = 10 + rng.randrange(100) / 100 + (rng.random() < 0.01) * rng.randrange(500)
        rows.append(trade(i, seconds, round(price, 2), ticker, rng.randrange(1, 50)))
    rng.shuffle(rows)
    return rows


def _zscores(rows, length=20, least=3.0):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        groups[row[2]].append(row)
    found = set()
    for ticker, series in groups.items():
        for i in range(length, len(series)):
            before = [round(r[3] * 100) for r in series[i - length : i]]
            spread = statistics.stdev(before)
            if spread > 0:
                z = (round(series[i][3] * 100) - statistics.mean(before)) / spread
                if abs(z) >= least:
                    found.add((ticker, series[i][0], round(z, 6)))
    return found


@pytest.mark.parametrize("rows_per_task", [10_000_000, 500, 60, 25])
def test_zscore_is_the_same_however_a_ticker_is_split(make, rows_per_task):
    rows = _skewed()
    found = anomaly.price_zscore(make(rows).repartition(6), rows_per_task=rows_per_task)
    got = {(r["ticker"], r["event_time"], round(r["score"], 6)) for r in found.collect()}
    assert got == _zscores(rows) and got


@pytest.mark.parametrize("rows_per_task", [10_000_000, 7])
def test_runs_shorter_than_the_reach(make, rows_per_task):
    rows = [trade(i, i, 1.0 + i) for i in range(300)]

    def columns(window):
        return {"sum": F.sum("price").over(window.rowsBetween(-40, -1))}

    df = make(rows).select("ticker", "event_time", "event_id", "price")
    out = over_preceding(df, "ticker", ("event_time", "event_id"), 40, columns, rows_per_task)
    got = [r["sum"] for r in out.orderBy("event_time").collect()]
    wanted = [sum(1.0 + j for j in range(max(0, i - 40), i)) or None for i in range(300)]
    assert got == wanted


@pytest.mark.parametrize("rows_per_task,quick", [(1000, True), (25, False)])
def test_both_ways_to_find_the_rows_before_a_run(make, monkeypatch, rows_per_task, quick):
    taken = []
    full = ordered._rows_before_runs

    def watched(*args):
        taken.append(True)
        return full(*args)

    monkeypatch.setattr(ordered, "_rows_before_runs", watched)
    rows = [trade(i, i // 3, 1.0 + i % 7) for i in range(9000)]
    df = make(rows).repartition(4)
    whole = sorted(map(str, anomaly.price_zscore(df, 20, 1.5).collect()))
    split = sorted(map(str, anomaly.price_zscore(df, 20, 1.5, rows_per_task).collect()))
    assert split == whole and whole
    assert bool(taken) is not quick


def test_no_task_gets_much_more_than_its_share(make, spark):
    rows = make(_skewed(8000)).select("ticker", "event_time", "event_id", "price")
    sizes = {}

    def columns(window):
        return {"run": F.col("_run"), "n": F.count(F.lit(1)).over(window.rowsBetween(-3, -1))}

    out = over_preceding(rows, "ticker", ("event_time", "event_id"), 3, columns, 200)
    sizes = [r["count"] for r in out.groupBy("ticker", "run").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) < 800


def test_rows_without_a_key_are_split_too(make):
    rows = make(_skewed(6000)).select("ticker", "event_time", "event_id", "price")
    rows = rows.withColumn("ticker", F.expr("nullif(ticker, 'H')"))

    def columns(window):
        return {"run": F.col("_run"), "n": F.count(F.lit(1)).over(window.rowsBetween(-3, -1))}

    order = ("event_time", "event_id")
    whole = over_preceding(rows, "ticker", order, 3, lambda w: {"n": columns(w)["n"]}).collect()
    split = over_preceding(rows, "ticker", order, 3, columns, 200)
    kept = split.select("ticker", *order, "price", "n").collect()
    assert sorted(map(str, kept)) == sorted(map(str, whole))
    sizes = [r["count"] for r in split.groupBy("ticker", "run").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 800


def test_jump_and_spike_are_the_same_when_split(make):
    df = make(_skewed(3000)).repartition(5).cache()
    for rule in (anomaly.price_jump, anomaly.volume_spike):
        whole = sorted(map(str, rule(df).collect()))
        assert whole == sorted(map(str, rule(df, rows_per_task=50).collect()))
        assert whole


def test_flat_price_and_short_history_give_no_zscore(make):
    flat = [trade(i, i, 0.1, "F") for i in range(30)] + [trade(99, 99, 50.0, "F")]
    short = [trade(200 + i, i, 1.0 + i % 2, "S") for i in range(19)] + [trade(300, 50, 99.0, "S")]
    enough = [trade(400 + i, i, 1.0 + i % 2, "E") for i in range(20)] + [trade(500, 50, 99.0, "E")]
    found = anomaly.price_zscore(make(flat + short + enough)).collect()
    assert [r["ticker"] for r in found] == ["E"]
    row = found[0]
    assert row["evidence"]["price"] == 99.0 and row["evidence"]["mean"] == 1.5
    assert (row["event_type"], row["rule"]) == ("anomaly", "price_zscore")


def test_bucket_rules_and_selection(make):
    rows = [trade(i, i, 1.0 + i, "A") for i in range(12)] + [trade(50, 4000, 5.0, "B")]
    df = make(rows)
    assert anomaly.trade_burst(df, "1 hour", 11).first()["score"] == 12.0
    assert anomaly.trade_burst(df, "1 hour", 12).count() == 0
    assert anomaly.price_range(df, "1 hour", 11.0).first()["score"] == 11.0
    every = anomaly.all_rules(df)
    assert {r["rule"] for r in every.collect()} == {"price_jump", "burst", "range"}
    assert anomaly.select_anomalies(every, tickers=["B"]).count() == 0
    text = anomaly.as_messages(anomaly.select_anomalies(every, rules=["burst"]), framed=True).first()
    assert text["value"].startswith('event: anomaly\ndata: {"event_type":"anomaly"')
    assert text["value"].endswith("\n\n")
