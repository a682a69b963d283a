import json

from pyspark.sql import functions as F

from conftest import trade
from tradeflow.operators.quality import normalize_trades
from tradeflow.sources import (
    append_batch,
    append_trades,
    compact_batches,
    export_json,
    read_batches,
    read_trades,
)


def test_append_counts_rows_and_takes_an_empty_batch(spark, make, tmp_path):
    path = str(tmp_path / "t")
    rows = make([trade(i, 40000 * i, 1.25) for i in range(10)])
    assert append_trades(rows, path) == 10
    assert append_trades(rows.limit(0), path) == 0
    assert append_trades(rows.where("event_id like '00000001%'"), path) == 1
    stored = read_trades(spark, path)
    assert stored.count() == 11
    assert dict(stored.dtypes)["price"] == "decimal(10,2)"
    assert stored.where(F.col("event_date") != F.to_date("event_time")).count() == 0


def test_a_batch_sent_again_replaces_itself(spark, make, tmp_path):
    path = str(tmp_path / "b")
    first = make([trade(i, 40000 * i) for i in range(6)])
    second = make([trade(10 + i, 40000 * i) for i in range(4)])
    for _ in range(2):
        assert append_batch(first, path, 0) == 6
    append_batch(second, path, 1)
    append_batch(second.limit(2), path, 1)
    assert read_batches(spark, path).count() == 8
    target = str(tmp_path / "c")
    assert compact_batches(spark, path, target, upto=1) == 8
    assert read_trades(spark, target).select("event_id").distinct().count() == 8


def test_exported_records(make):
    df = normalize_trades(make([trade(1, 1.5, 12.3)]))
    record = json.loads(export_json(df).first()["record"])
    assert record["price"] == "12.30" and record["volume"] == 1
    assert record["event_time"] == "2024-01-01T00:00:01.500000+00:00"


def test_days_are_counted_from_footers_and_give_the_newest_rows(spark, make, tmp_path):
    from datetime import date

    from tradeflow.operators import history
    from tradeflow.sources.storage import counted_days, day_counts, footer_reader

    path = str(tmp_path / "d")
    rows = make([trade(i, 3600 * 5 * i + (i % 7), 1.25) for i in range(60)] + [trade(99, 3600 * 5 * 59)])
    append_trades(rows, path)
    append_trades(make([trade(100 + i, 3600 * 5 * 59) for i in range(3)]), path)  # a second file a day
    stored = read_trades(spark, path)
    plain = {r["event_date"]: r["rows"] for r in stored.groupBy("event_date").count().withColumnRenamed("count", "rows").collect()}
    days = day_counts(spark, path)
    assert dict(days) == plain and [d for d, _ in days] == sorted(plain, reverse=True)
    assert dict(day_counts(spark, path, since=date(2024, 1, 10))) == {d: n for d, n in plain.items() if d >= date(2024, 1, 10)}
    with footer_reader(spark):
        plan = counted_days(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [event_date]" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    order = [F.desc("event_time"), F.desc("event_id")]
    for limit in (1, 5, 20, 100):
        want = [r["event_id"] for r in stored.orderBy(*order).limit(limit).collect()]
        got = [r["event_id"] for r in history.newest(stored, limit, days=days).collect()]
        assert got == want
    assert day_counts(spark, path, since=date(2030, 1, 1)) == []
