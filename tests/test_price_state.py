"""Price rules on Spark's state store against the batch rules."""

import random
import tempfile
from datetime import timedelta

import pandas as pd
from conftest import START, trade

from tradeflow.operators import anomaly
from pyspark.sql import functions as F

from tradeflow.schema import TRADE, TRADE_RAW
from tradeflow.streaming import price_state


def _rows(found):
    return sorted(
        (r["event_time"].replace(tzinfo=None), r["ticker"], r["rule"], round(r["score"], 9)) for r in found.collect()
    )


def test_stream_on_state_equals_batch_rules_on_closed_rows(spark):
    rng = random.Random(7)
    trades = []
    for k in range(400):
        price = round(rng.choice([10.0, 10.5, 11.0, 30.0, 10.2]), 2)
        trades.append(trade(k, rng.randrange(0, 40 * 3600), price, ticker=rng.choice(["A", "B", None])))
    trades.sort(key=lambda row: row[0])
    base = tempfile.mkdtemp()
    df = spark.createDataFrame(trades, TRADE_RAW).withColumn("price", F.col("price").cast(TRADE["price"].dataType))
    for k in range(4):  # deliveries of ten hours, each mixed by a few minutes
        part = df.where(
            (df.event_time >= START + timedelta(hours=10 * k, minutes=-5 if k else 0))
            & (df.event_time < START + timedelta(hours=10 * k + 10, minutes=-5 if k < 3 else 1))
        )
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(TRADE).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = price_state.start_price_rules(stream, f"{base}/out", f"{base}/ck", "12 hours", zscore=1.5, jump=0.5)
    query.awaitTermination()
    got = _rows(price_state.read_anomalies(spark, f"{base}/out"))
    newest = max(row[0] for row in trades)
    both = anomaly.price_zscore(df, least=1.5).unionByName(anomaly.price_jump(df, 0.5))
    want = _rows(both.where(both.event_time < newest - timedelta(hours=12)))
    assert got == want and len(got) > 5


def test_judge_keeps_the_last_prices_and_skips_a_zero_previous_price():
    rows = [(k, f"{k}", 10.0 if k % 2 else 11.0) for k in range(25)] + [(25, "25", 0.0), (26, "26", 40.0)]
    found, tail = price_state.judge([], rows, 20, 3.0, 0.5)
    assert len(tail) == 20 and tail[-1][0] == 26
    assert [f[3] for f in found if f[1] == 25] == ["price_zscore", "price_jump"]
    assert not [f for f in found if f[1] == 26 and f[3] == "price_jump"]


def test_whole_number_ids_of_one_instant_are_ordered_as_numbers(spark, tmp_path):
    rows = [(9, 10, "A", 10.0), (10, 10, "A", 40.0), (None, 9, "A", 10.0), (11, 90_000, "A", 40.0)]
    df = spark.createDataFrame(rows, "event_id long, second long, ticker string, price double")
    df = df.withColumn("event_time", F.timestamp_seconds("second")).drop("second")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    place = f"{tmp_path}/out"
    price_state.start_price_rules(stream, place, f"{tmp_path}/ck", "1 hour", zscore=None, jump=0.5).awaitTermination()
    found = [r["score"] for r in price_state.read_anomalies(spark, place).collect()]
    assert found == [3.0]  # 40 after 10; by text id 10 came before 9


class _Store:
    """A state handle and its variables in memory, which count their calls."""

    def __init__(self):
        self.calls, self.timers, self.states = 0, [], {}

    def _made(self, name, *_):
        outer = self

        class State(dict):
            def called(self, result=None):
                outer.calls += 1
                return result

            def exists(self):
                return self.called("value" in self)

            def get(self):
                return self.called(self.get_or("value"))

            def get_or(self, key):
                return dict.get(self, key, [] if name == "tail" else None)

            def put(self, value):
                self.called(self.__setitem__("value", value))

            def update(self, value):
                self.called(self.__setitem__("value", value))

            def containsKey(self, key):
                return self.called(key in self)

            def getValue(self, key):
                return self.called(self[key])

            def updateValue(self, key, value):
                self.called(self.__setitem__(key, value))

            def removeKey(self, key):
                self.called(self.pop(key))

        return self.states.setdefault(name, State())

    getMapState = getValueState = getListState = _made

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class _Clock:
    def __init__(self, millis):
        self.millis = millis

    def getCurrentWatermarkInMs(self):
        return self.millis

    getExpiryTimeInMs = getCurrentWatermarkInMs


def _run(batches, marks):
    """The records of batches of (micros, id, price), each at its watermark, and the store."""
    store, rules, records = _Store(), price_state.PriceRules(5, 1.5, 0.5), []
    rules.init(store)
    for rows, mark in zip(batches, marks, strict=True):
        pdf = pd.DataFrame(rows, columns=["micros", "event_id", "price"])
        pdf["event_time"] = pd.to_datetime(pdf["micros"], unit="us", utc=True)
        if len(pdf):
            for made in rules.handleInputRows(("A",), iter([pdf[::2], pdf[1::2]]), _Clock(mark)):
                records += made.to_dict("records")
        while due := [at for at in store.timers if at < mark]:
            for made in rules.handleExpiredTimer(("A",), _Clock(mark), _Clock(min(due))):
                records += made.to_dict("records")
            store.timers.remove(min(due))
    return records, store


def test_rows_move_to_and_from_the_state_by_thousands():
    rng = random.Random(3)
    rows = [(k * 1000 + 5, f"{k:06d}", rng.choice([10.0, 30.0])) for k in range(6000)]
    records, store = _run([rows[:4000], rows[4000:], []], [0, 3000, 9000])
    assert len(records) > 100 and store.calls < 100 and not store.timers


def test_overlapping_chunks_give_what_the_whole_order_gives(monkeypatch):
    monkeypatch.setattr(price_state, "RUN_ROWS", 70)
    monkeypatch.setattr(price_state, "CHUNK_ROWS", 16)
    rng = random.Random(4)
    rows = [(rng.randrange(900_000), f"{k:06d}", rng.choice([10.0, 11.0, 30.0])) for k in range(500)]
    early = [row for row in rows if row[0] < 500_000]
    batches = [early, [row for row in rows if row[0] >= 500_000], [(100_000, "x", 1.0)], []]
    records, store = _run(batches, [0, 300, 650, 1000])
    want, _ = price_state.judge([], sorted(rows), 5, 1.5, 0.5)
    got = [(r["micros"], r["event_id"], r["rule"], r["score"]) for r in records if r["kind"] == "anomaly"]
    assert got == [(f[1], f[2], f[3], f[4]) for f in want] and len(got) > 100
    assert [r["event_id"] for r in records if r["kind"] == "late"] == ["x"]
    assert not store.timers and not store.states["chunks"]
