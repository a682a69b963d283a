"""Windowed streams built from the same measures as the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import anomaly
from ..operators.candles import candle_measures, roll_up_measures, tick_measures
from ..functions import interval_seconds


def distinct_trades(trades: DataFrame, delay: str, salted: bool = False) -> DataFrame:
    """Each event id once, as long as copies arrive within ``delay``.

    ``salted`` first drops the copies within an input partition, so that an id
    with very many copies does not send them all to one task. It keeps a second
    state, and pays off only if such ids exist.
    """
    marked = trades.withWatermark("event_time", delay)
    if salted:
        marked = (
            marked.withColumn("_part", F.spark_partition_id())
            .dropDuplicatesWithinWatermark(["event_id", "_part"])
            .drop("_part")
        )
    return marked.dropDuplicatesWithinWatermark(["event_id"])


def windowed(
    trades: DataFrame, width: str, delay: str, measures: list[Column], *by: str
) -> DataFrame:
    """Aggregates per window of a stream, each emitted once its window is closed."""
    return (
        _with_watermark(trades, delay)
        .groupBy(F.window("event_time", width).alias("_window"), *by)
        .agg(*measures)
        .select(F.col("_window.start").alias("bucket_start"), "*")
        .drop("_window")
    )


def _with_watermark(trades: DataFrame, delay: str | None) -> DataFrame:
    """``delay`` is None where an earlier step of the stream has set the watermark."""
    return trades if delay is None else trades.withWatermark("event_time", delay)


def candle_stream(trades: DataFrame, width: str, delay: str | None) -> DataFrame:
    """High and low per ticker and tick."""
    return windowed(trades, width, delay, tick_measures(), "ticker")


def volume_stream(trades: DataFrame, width: str, delay: str | None) -> DataFrame:
    """Volume per ticker and window, the input of the spike rule."""
    return windowed(trades, width, delay, [F.sum("volume").alias("volume")], "ticker")


def arrival_stream(trades: DataFrame, width: str, delay: str | None) -> DataFrame:
    """Number of trades and newest trade time per window."""
    measures = [F.count(F.lit(1)).alias("rows"), F.max("event_time").alias("newest")]
    return windowed(trades, width, delay, measures)


def health_stream(
    trades: DataFrame, width: str, delay: str | None, accepted: Column, rejected: Column
) -> DataFrame:
    """Accepted trades, newest accepted time and rejected trades per window.

    One tagged stream, one watermark and one state: each trade is counted by the
    condition it meets, instead of aggregating accepted and rejected trades apart.
    """
    measures = [
        F.count(F.when(accepted, 1)).alias("rows"),
        F.max(F.when(accepted, F.col("event_time"))).alias("newest"),
        F.count(F.when(rejected, 1)).alias("rejected"),
    ]
    return windowed(trades, width, delay, measures)


def bucket_rule_stream(
    trades: DataFrame,
    width: str,
    delay: str | None,
    burst: int | None = None,
    price_range: float | None = None,
) -> DataFrame:
    """Anomalies of closed windows: too many trades, too wide a range, or both rules."""
    rules = []
    if burst is not None:
        rules.append(anomaly.burst_rule(burst))
    if price_range is not None:
        rules.append(anomaly.range_rule(price_range))
    buckets = windowed(trades, width, delay, anomaly.bucket_measures(), "ticker")
    return anomaly.emit(buckets, *rules)


def rollup_stream(trades: DataFrame, widths: list[str], delay: str | None) -> DataFrame:
    """Candles of the widest of ``widths`` through a chain of window aggregations.

    The first aggregation makes candles of ``widths[0]`` from trades; each next one
    groups the closed windows of the one before by ``window_time`` into wider windows,
    all in one query with one watermark, so no level reads trades again. Each width must
    be a multiple of the one before. In append mode a window is written once the
    watermark has passed its end, and with it every finer window it holds.
    """
    for finer, wider in zip(widths, widths[1:]):
        if interval_seconds(wider) % interval_seconds(finer):
            raise ValueError(f"{wider} is no multiple of {finer}")
    level = _with_watermark(trades, delay).groupBy(
        F.window("event_time", widths[0]).alias("_window"), "ticker"
    ).agg(*candle_measures())
    for width in widths[1:]:
        level = level.groupBy(
            F.window(F.window_time("_window"), width).alias("_window"), "ticker"
        ).agg(*roll_up_measures())
    return level.select(F.col("_window.start").alias("bucket_start"), "*").drop("_window")
