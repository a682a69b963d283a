"""Rules that flag unusual trades, each giving the same anomaly record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import bucket_start, interval_seconds, iso_text, same_clock
from ..schema import ANOMALY
from .ordered import ROWS_PER_TASK, over_preceding

EVENT_TYPE = "anomaly"
ORDER = ("event_time", "event_id")


def record(time: str, rule: str, score: Column, **evidence: Column) -> list[Column]:
    """The columns of an anomaly, with the numbers that led to it."""
    pairs: list[Column] = []
    for name, value in evidence.items():
        pairs += [F.lit(name), value.cast("double")]
    return [
        F.lit(EVENT_TYPE).alias("event_type"),
        F.col(time).alias("event_time"),
        F.col("ticker"),
        F.lit(rule).alias("rule"),
        score.cast("double").alias("score"),
        F.create_map(*pairs).alias("evidence"),
    ]


# A rule is a condition and the record of the rows that meet it.
Rule = tuple[Column, list[Column]]


def emit(rows: DataFrame, *rules: Rule) -> DataFrame:
    """The records of all rules, in one pass over the rows."""
    if len(rules) == 1:
        condition, columns = rules[0]
        return rows.where(condition).select(*columns)
    found = [F.when(condition, F.struct(*columns)) for condition, columns in rules]
    return rows.select(F.inline(F.array_compact(F.array(*found))))


# Rules over preceding rows need window columns. Batch and stream use the same.


def zscore_columns(window: WindowSpec, length: int = 20) -> dict[str, Column]:
    """Sums over the previous ``length`` prices, the current one excluded.

    Whole cents are summed, which is exact in doubles for valid prices: a flat
    price has a deviation of exactly zero.
    """
    before = window.rowsBetween(-length, -1)
    cents = F.round(F.col("price").cast("double") * 100)
    return {
        "_cents": cents,
        "_prices": F.count(F.lit(1)).over(before),
        "_sum": F.sum(cents).over(before),
        "_squares": F.sum(cents * cents).over(before),
    }


def zscore_rule(length: int = 20, least: float = 3.0) -> Rule:
    """At least ``least`` sample deviations from the mean of the previous prices."""
    spread = F.col("_squares") * length - F.col("_sum") * F.col("_sum")
    deviation = F.sqrt(F.nullif(spread, F.lit(0.0)) / (length * (length - 1)))
    mean = F.col("_sum") / length
    z = (F.col("_cents") - mean) / deviation
    numbers = {"price": F.col("price"), "mean": mean / 100, "deviation": deviation / 100}
    condition = (F.col("_prices") == length) & (spread > 0) & (F.abs(z) >= least)
    return condition, record("event_time", "price_zscore", z, **numbers)


def jump_columns(window: WindowSpec) -> dict[str, Column]:
    return {"_previous": F.lag("price").over(window)}


def jump_rule(least: float = 0.5) -> Rule:
    """Away from the previous price by at least ``least`` of it."""
    change = F.col("price").cast("double") / F.nullif("_previous", F.lit(0)) - 1
    numbers = {"price": F.col("price"), "previous": F.col("_previous")}
    return F.abs(change) >= least, record("event_time", "price_jump", change, **numbers)


def spike_columns(window: WindowSpec, length: int = 5) -> dict[str, Column]:
    before = window.rowsBetween(-length, -1)
    return {
        "_buckets": F.count(F.lit(1)).over(before),
        "_volumes": F.sum("volume").over(before),
    }


def spike_rule(length: int = 5, times: float = 3.0) -> Rule:
    """At least ``times`` the mean volume of the previous buckets."""
    mean, volume = F.col("_volumes") / length, F.col("volume")
    condition = (F.col("_buckets") == length) & (volume >= mean * times)
    ratio = volume / F.nullif(mean, F.lit(0.0))
    return condition, record("bucket_start", "volume_spike", ratio, volume=volume, mean=mean)


# Rules within one bucket need no order, only aggregates.


def bucket_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("trades"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum("volume").alias("volume"),
    ]


def burst_rule(most: int) -> Rule:
    trades = F.col("trades")
    return trades > most, record("bucket_start", "burst", trades, trades=trades, limit=F.lit(most))


def range_rule(least: float) -> Rule:
    high, low = F.col("high").cast("double"), F.col("low").cast("double")
    width = (high - low) / F.nullif(low, F.lit(0.0))
    return width >= least, record("bucket_start", "range", width, high=high, low=low)


# Batch forms.


def _with_previous_prices(trades: DataFrame, reach: int, columns, rows_per_task: int) -> DataFrame:
    pruned = trades.select("ticker", *ORDER, "price")
    return over_preceding(pruned, "ticker", ORDER, reach, columns, rows_per_task)


def price_zscore(
    trades: DataFrame, length: int = 20, least: float = 3.0, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Trades whose price is far from the previous ``length`` prices of the ticker."""
    rows = _with_previous_prices(
        trades, length, lambda window: zscore_columns(window, length), rows_per_task
    )
    return emit(rows, zscore_rule(length, least))


def price_jump(
    trades: DataFrame, least: float = 0.5, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Trades whose price differs from the previous one by ``least`` or more of it."""
    rows = _with_previous_prices(trades, 1, jump_columns, rows_per_task)
    return emit(rows, jump_rule(least))


def buckets(trades: DataFrame, width: str) -> DataFrame:
    """Trades, price bounds and volume per ticker and bucket."""
    bucketed = trades.withColumn("bucket_start", bucket_start("event_time", width))
    return bucketed.groupBy("ticker", "bucket_start").agg(*bucket_measures())


def _with_previous_buckets(
    trades: DataFrame, width: str, length: int, rows_per_task: int
) -> DataFrame:
    # No ticker can have more buckets than the whole span holds. Reading one
    # column for that is cheaper than building the buckets twice.
    step = interval_seconds(width)
    second = F.unix_seconds(F.col("event_time").cast("timestamp"))
    span = trades.agg(F.min(second).alias("first"), F.max(second).alias("last")).first()
    most = 0 if span["first"] is None else (span["last"] - span["first"]) // step + 2
    return over_preceding(
        buckets(trades, width),
        "ticker",
        ("bucket_start",),
        length,
        lambda window: spike_columns(window, length),
        rows_per_task,
        most,
    )


def volume_spike(
    trades: DataFrame,
    width: str = "1 minute",
    length: int = 5,
    times: float = 3.0,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Buckets with ``times`` the mean volume of the previous ``length`` ones.

    Buckets without trades do not count as previous ones.
    """
    rows = _with_previous_buckets(trades, width, length, rows_per_task)
    return emit(rows, spike_rule(length, times))


def trade_burst(trades: DataFrame, width: str = "1 hour", most: int = 10) -> DataFrame:
    """Buckets with more than ``most`` trades of a ticker."""
    return emit(buckets(trades, width), burst_rule(most))


def price_range(trades: DataFrame, width: str = "1 hour", least: float = 5.0) -> DataFrame:
    """Buckets in which the price spans ``least`` times its low or more."""
    return emit(buckets(trades, width), range_rule(least))


@dataclass(frozen=True)
class Limits:
    """Limits of all rules."""

    prices: int = 20
    zscore: float = 3.0
    jump: float = 0.5
    volumes: int = 5
    spike: float = 3.0
    burst: int = 10
    range: float = 5.0


def all_rules(
    trades: DataFrame,
    width: str = "1 hour",
    limits: Limits = Limits(),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The anomalies of every rule: one pass over the prices, one over the buckets."""

    def price_columns(window: WindowSpec) -> dict[str, Column]:
        return {**zscore_columns(window, limits.prices), **jump_columns(window)}

    by_price = emit(
        _with_previous_prices(trades, limits.prices, price_columns, rows_per_task),
        zscore_rule(limits.prices, limits.zscore),
        jump_rule(limits.jump),
    )
    by_bucket = emit(
        _with_previous_buckets(trades, width, limits.volumes, rows_per_task),
        spike_rule(limits.volumes, limits.spike),
        burst_rule(limits.burst),
        range_rule(limits.range),
    )
    return by_price.unionByName(by_bucket)


def select_anomalies(
    anomalies: DataFrame,
    tickers: Sequence[str] | None = None,
    rules: Sequence[str] | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Anomalies of some tickers and rules in start <= event_time < end."""
    if tickers is not None:
        anomalies = anomalies.where(F.col("ticker").isin(*tickers))
    if rules is not None:
        anomalies = anomalies.where(F.col("rule").isin(*rules))
    if start is not None:
        anomalies = anomalies.where(
            F.col("event_time") >= same_clock(anomalies, "event_time", start)
        )
    if end is not None:
        anomalies = anomalies.where(F.col("event_time") < same_clock(anomalies, "event_time", end))
    return anomalies


def as_messages(anomalies: DataFrame, framed: bool = False) -> DataFrame:
    """Anomalies as JSON text in ``value``, or framed as server-sent events."""
    names = [field.name for field in ANOMALY.fields]
    shown = anomalies.withColumn("event_time", iso_text(anomalies, "event_time")).select(*names)
    text = F.to_json(F.struct("*"))
    if framed:
        text = F.concat(F.lit(f"event: {EVENT_TYPE}\ndata: "), text, F.lit("\n\n"))
    return shown.select("ticker", text.alias("value"))
