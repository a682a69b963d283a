"""Newest price per ticker, and the tick messages of subscribers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candles import tick_message


def latest(trades: DataFrame) -> DataFrame:
    """Newest price of every ticker, ties by id. Can be applied to its own results."""
    when = F.struct("event_time", "event_id")
    return (
        trades.groupBy("ticker")
        .agg(F.max_by("price", when).alias("price"), F.max(when).alias("last"))
        .select("ticker", "price", "last.event_time", "last.event_id")
    )


def newest_requests(subscriptions: DataFrame) -> DataFrame:
    """The last request of each subscriber decides on ticker and tick."""
    request = F.struct("updated_at", "ticker", "tick")
    return (
        subscriptions.groupBy("sub_id")
        .agg(F.max(request).alias("request"))
        .select("sub_id", "request.ticker", "request.tick", "request.updated_at")
    )


def messages(subscriptions: DataFrame, prices: DataFrame) -> DataFrame:
    """One message per subscriber with the newest price; null data if there is none.

    Neither side has a fixed size, so the join strategy is left to adaptive
    execution, which broadcasts a small side and splits a popular ticker.
    """
    joined = newest_requests(subscriptions).join(
        prices.select("ticker", "price"), "ticker", "left"
    )
    return joined.select("sub_id", *tick_message("price", "price"))


def tick_records(ticks: DataFrame) -> DataFrame:
    """Ticks with high and low as the messages their subscribers receive."""
    return ticks.select("sub_id", "bucket_end", *tick_message())
