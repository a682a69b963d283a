"""Per interval: did trades arrive, how far behind, and was anything unusual."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bucket_start, interval, same_clock
from .candles import calendar


def arrivals(trades: DataFrame, width: str) -> DataFrame:
    """Number of trades and newest trade time per interval."""
    return (
        trades.withColumn("bucket_start", bucket_start("event_time", width))
        .groupBy("bucket_start")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("event_time").alias("newest"))
    )


def _per_bucket(events: DataFrame, width: str, name: str) -> DataFrame:
    bucketed = events.withColumn("bucket_start", bucket_start("event_time", width))
    return bucketed.groupBy("bucket_start").agg(F.count(F.lit(1)).alias(name))


def health(
    arrived: DataFrame,
    width: str,
    anomalies: DataFrame | None = None,
    rejected: DataFrame | None = None,
    slow: str = "1 minute",
    start: datetime | None = None,
    as_of: datetime | None = None,
    rejected_counts: DataFrame | None = None,
) -> DataFrame:
    """One row for every interval, also the empty ones, with a status.

    ``lag_seconds`` is the silence at the end of the interval. "none" means no
    trade came, "failed" that only rejected ones came, and "delayed" that the
    silence is longer than ``slow``. Counts that are not asked for are null. The
    intervals reach from the first to the last event of any kind, and to those of
    ``start`` and ``as_of`` where given, so that silence up to now can be seen.
    ``rejected_counts`` (``bucket_start``, ``rejected``) may stand for ``rejected``
    where a stream has counted them already.
    """
    end = F.col("bucket_start") + interval(width)
    counts = {
        name: None if events is None else _per_bucket(events, width, name)
        for name, events in (("anomalies", anomalies), ("rejected", rejected))
    }
    if rejected_counts is not None:
        counts["rejected"] = rejected_counts.select("bucket_start", "rejected")
    seen = arrived.select("bucket_start")
    for found in counts.values():
        if found is not None:
            seen = seen.unionByName(found.select("bucket_start"))
    span = seen.agg(F.min("bucket_start").alias("first"), F.max("bucket_start").alias("last"))
    # One window expression per projection is all that Spark takes.
    for name, moment, outer in (("first", start, F.least), ("last", as_of, F.greatest)):
        if moment is not None:
            given = bucket_start(same_clock(arrived, "bucket_start", moment), width)
            span = span.withColumn("given", given).withColumn(name, outer(name, "given"))
    span = span.select(
        F.coalesce("first", "last").alias("first"), F.coalesce("last", "first").alias("last")
    )
    rows = calendar(span, width).join(arrived, "bucket_start", "left")
    zero = F.lit(0).cast("long")
    for name, found in counts.items():
        if found is None:
            rows = rows.withColumn(name, F.lit(None).cast("long"))
        else:
            rows = rows.join(found, "bucket_start", "left")
            rows = rows.withColumn(name, F.coalesce(name, zero))
    newest = F.col("newest")
    status = (
        F.when(newest.isNull() & (F.col("rejected") > 0), "failed")
        .when(newest.isNull(), "none")
        .when(newest < end - interval(slow), "delayed")
        .otherwise("ok")
    )
    return rows.select(
        "bucket_start",
        F.coalesce("rows", zero).alias("rows"),
        "newest",
        (F.timestamp_diff("MICROSECOND", newest, end) / 1e6).alias("lag_seconds"),
        "anomalies",
        "rejected",
        status.alias("status"),
    )
