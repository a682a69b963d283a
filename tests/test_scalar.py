import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tradeflow.functions import exact_total, interval, iso_text, round_price, same_clock


def test_round_price_is_the_ieee_rounding_of_the_stored_value(spark):
    rng = random.Random(5)
    values = [2.675, 1.005, 0.125, 0.375, 0.001, 0.005, 0.015, 9999.995, 10000.0, 1.15, 64.1]
    values += [rng.uniform(0, 10000) for _ in range(3000)]
    values += [rng.randrange(1, 2_000_000) / 200 for _ in range(3000)]
    values += [rng.randrange(1, 1_000_000) / 100 for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "price double")
    rows = df.select("price", round_price(F.col("price")).alias("rounded")).collect()
    wrong = [r for r in rows if f"{round(r['price'], 2):.2f}" != str(r["rounded"])]
    assert wrong == []


def test_exact_total_passes_the_range_of_long(spark):
    df = spark.range(40).select(F.lit(1 << 60).alias("amount"))
    total = df.agg(exact_total(F.col("amount")).alias("t")).first()["t"]
    assert int(total) == 40 * (1 << 60)


def test_iso_text_drops_a_zero_fraction(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 03:04:05' a, TIMESTAMP_NTZ'2024-01-02 03:04:05.06' b")
    row = df.select(iso_text(df, "a").alias("a"), iso_text(df, "b").alias("b")).first()
    for name, micros in (("a", 0), ("b", 60000)):
        moment = datetime(2024, 1, 2, 3, 4, 5, micros, timezone.utc)
        assert row[name] == moment.isoformat()


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_same_clock_keeps_the_type_and_the_moment(spark, kind):
    df = spark.sql(f"SELECT CAST('2024-01-02 03:04:05' AS {kind}) t")
    naive = datetime(2024, 1, 2, 3, 4, 5)
    aware = naive.replace(tzinfo=timezone.utc).astimezone(timezone(timedelta(hours=9)))
    for moment in (naive, aware):
        limit = same_clock(df, "t", moment)
        assert df.where(F.col("t") == limit).count() == 1
        assert df.select(limit.alias("x")).schema["x"].dataType.simpleString() == kind


def test_interval_takes_only_a_width():
    with pytest.raises(ValueError):
        interval("1 day'; DROP")
