import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import START, trade
from tradeflow.operators import anomaly, candles
from tradeflow.operators.latest import latest
from tradeflow.schema import TRADE_COLUMNS, TRADE_RAW
from tradeflow.sources import append_batch, read_batches, read_changes
from tradeflow.streaming import anomaly as rules
from tradeflow.streaming import changes, sinks, state, subscriptions, windows


def _rows(count=600, seconds=3000, seed=4):
    rng = random.Random(seed)
    rows = [
        trade(i, rng.randrange(seconds * 10) / 10, rng.randrange(100, 9000) / 100,
              rng.choice("AABC"), rng.randrange(1, 90))
        for i in range(count)
    ]
    return sorted(rows)


def _spread(rows, files, seed=2):
    """Cut into files in time order, swap neighbours across cuts, shuffle inside."""
    rng = random.Random(seed)
    size = -(-len(rows) // files)
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    for a, b in zip(parts, parts[1:]):
        a[-5:], b[:5] = b[:5], a[-5:]
    for part in parts:
        rng.shuffle(part)
    return parts


def _set(df):
    return sorted(map(tuple, df.collect()))


def test_closed_candles_of_a_stream_are_those_of_the_batch(spark, make, feed_files, stream_of, tmp_path):
    rows = _rows()
    for n, part in enumerate(_spread(rows, 6)):
        folder = feed_files(n, part)
    stream = windows.candle_stream(stream_of(folder), "7 seconds", "5 minutes")
    state.finish(state.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    found = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    mark = max(r[0] for r in rows) - timedelta(minutes=5)
    whole = candles.tick_candles(make(rows), "7 seconds").where(
        F.col("bucket_start") + F.expr("INTERVAL 7 SECONDS") <= F.lit(mark)
    )
    names = ["ticker", "bucket_start", "high", "low", "trades"]
    assert _set(found.select(names)) == _set(whole.select(names))


def test_chained_windows_of_a_stream_equal_the_batch_roll_up_on_closed_windows(
    spark, make, feed_files, stream_of, tmp_path
):
    rows = _rows(900, 4 * 3600, seed=6)
    for n, part in enumerate(_spread(rows, 6)):
        folder = feed_files(n, part)
    stream = windows.rollup_stream(stream_of(folder), ["10 seconds", "1 minute", "30 minutes"], "5 minutes")
    state.finish(state.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    found = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    mark = max(r[0] for r in rows) - timedelta(minutes=5)
    fine = candles.candles(make(rows), "10 seconds")
    whole = candles.roll_up(candles.roll_up(fine, "1 minute"), "30 minutes").where(
        F.col("bucket_start") + F.expr("INTERVAL 30 MINUTES") <= F.lit(mark)
    )
    names = ["ticker", "bucket_start", "open", "high", "low", "close", "volume", "trades", "cents"]
    assert len(_set(whole)) >= 10
    assert _set(found.select(names)) == _set(whole.select(names))
    with pytest.raises(ValueError):
        windows.rollup_stream(stream_of(folder), ["1 minute", "90 seconds"], "5 minutes")


def test_late_rows_change_nothing_and_are_counted(spark, feed_files, stream_of, tmp_path):
    feed_files(0, [trade(1, 10), trade(2, 1000)])
    feed_files(1, [trade(3, 2000)])
    folder = feed_files(2, [trade(4, 11, 99.0), trade(5, 3000)])
    stream = windows.candle_stream(stream_of(folder), "10 seconds", "1 minute")
    query = state.finish(state.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    assert state.late_rows(query) == 1
    assert spark.read.parquet(f"{tmp_path}/out").where("high > 50").count() == 0


@pytest.mark.parametrize("salted", [False, True])
def test_copies_in_one_and_in_several_batches(spark, feed_files, stream_of, tmp_path, salted):
    rows = _rows(100)
    feed_files(0, rows[:60] + rows[:60] + [rows[0]] * 50)
    folder = feed_files(1, rows[40:] + rows[90:])
    stream = windows.distinct_trades(stream_of(folder), "1 day", salted)
    state.finish(state.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    found = spark.read.schema(TRADE_RAW).parquet(f"{tmp_path}/out")
    assert sorted(r["event_id"] for r in found.collect()) == sorted(r[1] for r in rows)


def test_dedup_feeds_candles_in_one_stream(spark, make, feed_files, stream_of, tmp_path):
    rows = _rows(200)
    feed_files(0, rows[:120] + rows[:30])
    folder = feed_files(1, rows[100:])
    once = windows.distinct_trades(stream_of(folder), "5 minutes")
    stream = windows.candle_stream(once, "1 minute", None)
    state.finish(state.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    found = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    whole = {
        (r["ticker"], r["bucket_start"]): r["trades"]
        for r in candles.tick_candles(make(rows), "1 minute").collect()
    }
    got = {(r["ticker"], r["bucket_start"]): r["trades"] for r in found.collect()}
    assert got and all(whole[key] == trades for key, trades in got.items())


def test_restart_loses_and_doubles_nothing(spark, feed_files, stream_of, tmp_path):
    rows = _rows(90)
    path = f"{tmp_path}/out"
    for n in range(3):
        folder = feed_files(n, rows[30 * n : 30 * n + 30])

        def step(batch, batch_id):
            append_batch(batch, path, batch_id)
            append_batch(batch, path, batch_id)

        state.finish(state.start_batches(stream_of(folder), step, f"{tmp_path}/cp"))
    stored = read_batches(spark, path)
    assert sorted(r["event_id"] for r in stored.collect()) == sorted(r[1] for r in rows)


def test_a_new_request_is_seen_between_batches(spark, make, feed_files, stream_of, tmp_path):
    rows = _rows(500)
    parts = [rows[:250], rows[250:]]
    schema = "sub_id string, ticker string, tick int, updated_at timestamp"
    requests = [("s7", "A", 7, START), ("s60", "A", 60, START), ("bad", "A", 61, START),
                ("move", "B", 10, START), ("none", "ZZZ", 5, START)]

    def reader(session):
        return session.createDataFrame(requests, schema)

    for n, part in enumerate(parts):
        folder = feed_files(n, part)
        if n == 1:
            requests.append(("move", "C", 5, START + timedelta(seconds=1)))
        query = subscriptions.start_ticks(
            stream_of(folder), reader, f"{tmp_path}/out", f"{tmp_path}/cp", "10 seconds"
        )
        state.finish(query)

    mark = max(r[0] for r in rows) - timedelta(seconds=10)
    switch = max(r[0] for r in parts[0]) - timedelta(seconds=10)

    def expected(ticker, tick, low, high):
        out = {}
        for row in rows:
            second = row[0].replace(microsecond=0)
            closes = second + timedelta(seconds=1)
            if row[2] == ticker and closes <= high and (low is None or closes > low):
                epoch = int((second - datetime(1970, 1, 1)).total_seconds())
                end = datetime(1970, 1, 1) + timedelta(seconds=(epoch // tick + 1) * tick)
                out.setdefault(end, []).append(row[3])
        return {end: (max(p), min(p), len(p)) for end, p in out.items()}

    def got(sub, ticker):
        found = subscriptions.read_ticks(spark, f"{tmp_path}/out", sub).where(F.col("ticker") == ticker)
        return {r["bucket_end"]: (r["high"], r["low"], r["trades"]) for r in found.collect()}

    assert got("s7", "A") == expected("A", 7, None, mark)
    assert got("s60", "A") == expected("A", 60, None, mark)
    assert got("move", "B") == expected("B", 10, None, switch)
    assert got("move", "C") == expected("C", 5, switch, mark)
    everyone = subscriptions.read_ticks(spark, f"{tmp_path}/out")
    assert {r["sub_id"] for r in everyone.select("sub_id").distinct().collect()} == {"s7", "s60", "move"}


def test_newest_prices_are_kept_over_batches(spark, make, feed_files, stream_of, tmp_path):
    rows = _rows(120)
    for n, part in enumerate(_spread(rows, 4)):
        folder = feed_files(n, part)
    path = f"{tmp_path}/out"
    assert subscriptions.read_prices(spark, path).count() == 0
    state.finish(subscriptions.start_prices(stream_of(folder), path, f"{tmp_path}/cp"))
    assert _set(subscriptions.read_prices(spark, path)) == _set(latest(make(rows)))
    assert len(state.finished_batches(spark, path)) == 3


def test_sampler_sends_unchanged_prices_again(spark, make, feed_files, stream_of, tmp_path):
    folder = feed_files(0, [trade(1, 1, 12.5)])
    prices = f"{tmp_path}/prices"
    state.finish(subscriptions.start_prices(stream_of(folder), prices, f"{tmp_path}/cp1"))
    schema = "sub_id string, ticker string, tick int, updated_at timestamp"
    rows = [("a", "AAPL", 1, START), ("b", "AAPL", 2, START), ("c", "ZZZ", 1, START), ("d", "AAPL", 0, START)]
    out = f"{tmp_path}/out"
    query = subscriptions.start_sampler(
        spark, prices, lambda s: s.createDataFrame(rows, schema), out, f"{tmp_path}/cp2"
    )
    deadline = time.time() + 60
    while len(state.finished_batches(spark, out)) < 4 and time.time() < deadline:
        time.sleep(0.5)
    query.stop()
    sent = spark.read.parquet(out).collect()
    counts = {sub: sum(r["sub_id"] == sub for r in sent) for sub in "abcd"}
    assert counts["a"] >= 4 and counts["a"] == counts["c"] and counts["d"] == 0
    assert abs(counts["b"] * 2 - counts["a"]) <= 1
    assert {r["data"]["high"] for r in sent if r["sub_id"] != "c"} == {12.5}
    assert {r["data"] for r in sent if r["sub_id"] == "c"} == {None}


def test_due_messages_follow_each_tick(spark, make):
    schema = "sub_id string, ticker string, tick int, updated_at timestamp"
    subs = spark.createDataFrame([("a", "AAPL", 7, START), ("b", "AAPL", 60, START)], schema)
    sent = subscriptions.due_messages(subs, latest(make([trade(1, 1)])), 100, 130)
    due = sorted((r["sub_id"], int(r["due"].timestamp())) for r in sent.collect())
    assert due == [("a", 105), ("a", 112), ("a", 119), ("a", 126), ("b", 120)]


@pytest.mark.parametrize("rows_per_task", [1_000_000, 40])
@pytest.mark.parametrize("name", ["zscore", "both"])
def test_ordered_rules_over_a_stream_equal_the_batch(
    spark, make, feed_files, stream_of, tmp_path, name, rows_per_task
):
    rule, batch = {
        "zscore": (rules.price_rules(20, 2.0, None), lambda df: anomaly.price_zscore(df, 20, 2.0)),
        "both": (
            rules.price_rules(20, 2.0, 3.0),
            lambda df: anomaly.price_zscore(df, 20, 2.0).unionByName(anomaly.price_jump(df, 3.0)),
        ),
    }[name]
    rows = _rows(500)
    parts = _spread(rows, 5)
    for n, part in enumerate(parts):
        folder = feed_files(n, part)
        if n in (2, 4):
            # Started twice: the second run resumes from the checkpoint.
            query = rules.start_rules(
                stream_of(folder), rule, f"{tmp_path}/out", f"{tmp_path}/cp", "3 minutes",
                rows_per_task=rows_per_task,
            )
            state.finish(query)
    mark = max(r[0] for r in rows) - timedelta(minutes=3)
    wanted = batch(make(rows)).where(F.col("event_time") < F.lit(mark))
    got = rules.read_anomalies(spark, f"{tmp_path}/out")

    def shown(df):
        return sorted(
            (r["ticker"], r["event_time"], r["rule"], round(r["score"], 9)) for r in df.collect()
        )

    assert shown(got) == shown(wanted) and shown(got)
    assert rules.count_late(spark, f"{tmp_path}/out") == 0


def test_rows_behind_the_closed_time_are_kept_apart(spark, feed_files, stream_of, tmp_path):
    feed_files(0, [trade(1, 10), trade(2, 1000)])
    folder = feed_files(1, [trade(3, 20), trade(4, 2000)])
    query = rules.start_rules(
        stream_of(folder), rules.price_rules(), f"{tmp_path}/out", f"{tmp_path}/cp", "1 minute"
    )
    state.finish(query)
    assert rules.count_late(spark, f"{tmp_path}/out") == 1


def test_volume_spike_over_closed_windows(spark, make, feed_files, stream_of, tmp_path):
    rows = _rows(600)
    for n, part in enumerate(_spread(rows, 5)):
        folder = feed_files(n, part)
    stream = windows.volume_stream(stream_of(folder), "1 minute", "2 minutes")
    rule = rules.volume_rules(5, 1.5)
    query = rules.start_rules(stream, rule, f"{tmp_path}/out", f"{tmp_path}/cp", None)
    state.finish(query)
    mark = max(r[0] for r in rows) - timedelta(minutes=2)
    wanted = anomaly.volume_spike(make(rows), "1 minute", 5, 1.5).where(
        F.col("event_time") + F.expr("INTERVAL 1 MINUTE") <= F.lit(mark)
    )
    columns = ["ticker", "event_time", "score"]
    got = rules.read_anomalies(spark, f"{tmp_path}/out").select(columns)
    assert _set(got) == _set(wanted.select(columns)) and got.count()


def test_change_stream_keeps_the_table_current(spark, tmp_path):
    def event(op, at, number, price):
        row = dict(zip(TRADE_COLUMNS, trade(number, number, price)))
        row["event_time"] = row["event_time"].isoformat() + "Z"
        sides = {"before": row if op == "d" else None, "after": None if op == "d" else row}
        return json.dumps({"op": op, **sides, "ts_ms": at})

    feed = tmp_path / "feed"
    feed.mkdir()
    batches = [
        [event("c", 1, 1, 1.0), event("c", 1, 2, 2.0), "broken"],
        [event("u", 3, 1, 1.5), event("d", 3, 2, 2.0), event("c", 2, 3, 3.0)],
        [event("u", 2, 2, 9.0), event("u", 2, 1, 9.0), event("c", 2, 3, 3.0)],
    ]
    out = str(tmp_path / "out")
    for n, lines in enumerate(batches):
        (feed / f"{n}.json").write_text("\n".join(lines))
        raw = read_changes(spark, path=str(feed), maxFilesPerTrigger="1")
        state.finish(changes.start_changes(raw, out, str(tmp_path / "cp")))
        if n == 1:
            changes.compact(spark, out)
    got = {int(r["event_id"][:8], 16): r["price"] for r in changes.read_current(spark, out).collect()}
    # The update of row 2 is older than its deletion, and arrives after compaction.
    assert got == {1: 1.5, 3: 3.0}
    changes.compact(spark, out)
    assert changes.read_current(spark, out).count() == 2
    assert changes.read_rejected(spark, out).first()["value"] == "broken"


def test_source_of_changes_is_named_once(spark):
    with pytest.raises(ValueError):
        read_changes(spark)


def test_window_anomalies_go_out_as_text(spark, make, feed_files, stream_of, tmp_path):
    rows = [trade(i, i) for i in range(30)] + [trade(99, 4000)]
    folder = feed_files(0, rows)
    found = windows.bucket_rule_stream(stream_of(folder), "1 minute", "1 minute", 20)
    text = anomaly.as_messages(anomaly.select_anomalies(found, ["AAPL"], ["burst"]))
    query = sinks.start_messages(text, f"{tmp_path}/cp", path=f"{tmp_path}/out")
    state.finish(query)
    sent = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert [(m["event_time"], m["score"]) for m in sent] == [("2024-01-01T00:00:00+00:00", 30.0)]
    with pytest.raises(ValueError):
        sinks.start_messages(text, f"{tmp_path}/cp")


def test_stored_dedup_catches_copies_after_any_delay_and_keeps_late_originals(spark, make, tmp_path):
    from tradeflow.streaming import stored_dedup

    path = str(tmp_path / "kept")

    def run(rows, batch_id):
        kept = stored_dedup.new_trades(make(rows), path, batch_id)
        kept.write.mode("overwrite").partitionBy("event_date").parquet(state.batch_path(path, batch_id))

    first = [trade(k, 86400 * (k % 3) + k) for k in range(30)] + [trade(1, 86400 + 1), trade(40, 0, event_time=None)]
    run(first, 0)
    run([trade(k, 86400 * (k % 3) + k) for k in range(0, 30, 2)] + [trade(50, 5), trade(40, 0, event_time=None)], 1)
    run([trade(k, 86400 * (k % 3) + k) for k in range(0, 30, 2)] + [trade(50, 5), trade(40, 0, event_time=None)], 1)  # retried
    run([trade(k, 86400 * (k % 3) + k) for k in range(1, 30, 5)] + [trade(60, 86400 * 40)], 2)
    stored = stored_dedup.read_stored(spark, TRADE_RAW, path)
    ids = [r["event_id"][:8] for r in stored.collect()]
    assert sorted(ids) == sorted({f"{k:08x}" for k in [*range(30), 40, 50, 60]})


def test_health_of_one_tagged_stream_equals_the_batch_health_on_closed_windows(spark, make, feed_files, stream_of, tmp_path):
    from tradeflow.operators import health

    rows = _rows(500, 3 * 3600, seed=9)
    for n, part in enumerate(_spread(rows, 5)):
        folder = feed_files(n, part)
    price = F.col("price")
    stream = windows.health_stream(stream_of(folder), "10 minutes", "5 minutes", price <= 60, price > 60)
    state.finish(state.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp"))
    closed = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
    live = health.health(
        closed.where("rows > 0").select("bucket_start", "rows", "newest"),
        "10 minutes",
        rejected_counts=closed.where("rejected > 0"),
    )
    trades = make(rows)
    names = ["bucket_start", "rows", "newest", "rejected", "status"]
    whole = health.health(health.arrivals(trades.where(price <= 60), "10 minutes"), "10 minutes",
                          rejected=trades.where(price > 60))
    ends = [r["bucket_start"] for r in closed.collect()]
    assert ends and _set(live.select(names)) == _set(whole.where(F.col("bucket_start") <= max(ends)).select(names))


def test_sampler_on_a_clock_covers_an_uneven_span_exactly_once(spark, make, feed_files, stream_of, tmp_path):
    folder = feed_files(0, [trade(1, 1, 12.5)])
    prices = f"{tmp_path}/prices"
    state.finish(subscriptions.start_prices(stream_of(folder), prices, f"{tmp_path}/cp1"))
    schema = "sub_id string, ticker string, tick int, updated_at timestamp"
    rows = [("a", "AAPL", 1, START), ("b", "AAPL", 7, START), ("c", "ZZZ", 3, START)]
    subs = spark.createDataFrame(rows, schema)
    out = f"{tmp_path}/out"
    subscriptions.sample_span(spark, prices, lambda s: subs, out, f"{tmp_path}/cp2", 1000, 50, per_batch=20)
    sent = sorted((r["sub_id"], int(r["due"].timestamp())) for r in spark.read.parquet(out).collect())
    whole = subscriptions.due_messages(subs, subscriptions.read_prices(spark, prices), 1000, 1049)
    assert sent == sorted((r["sub_id"], int(r["due"].timestamp())) for r in whole.collect())
    assert len(sent) == 50 + 7 + 16 and state.finished_batches(spark, out) == [0, 1, 2]
    with pytest.raises(ValueError):
        subscriptions.sample_span(spark, prices, lambda s: subs, out, f"{tmp_path}/cp3", 0, 0)
