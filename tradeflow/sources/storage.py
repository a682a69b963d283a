"""Trade table on shared storage: parquet, one folder per day."""

from __future__ import annotations

import contextlib
import logging
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TRADE, TRADE_COLUMNS

STORED = T.StructType([*TRADE.fields, T.StructField("event_date", T.DateType())])


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """All trades. ``event_date`` is kept so that time filters can prune folders."""
    return spark.read.schema(STORED).parquet(path)


@contextlib.contextmanager
def footer_reader(spark: SparkSession) -> Iterator[None]:
    """Parquet's own reader with aggregate push-down, for the time of the block."""
    wanted = {
        "spark.sql.parquet.aggregatePushdown": "true",
        "spark.sql.sources.useV1SourceList": ",".join(
            name
            for name in spark.conf.get("spark.sql.sources.useV1SourceList").split(",")
            if name.strip().lower() != "parquet"
        ),
    }
    saved = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value)


def counted_days(spark: SparkSession, path: str, since: date | None = None) -> DataFrame:
    """Rows per day of the stored table; inside ``footer_reader`` only footers are read."""
    days = spark.read.schema(STORED).parquet(path)
    if since is not None:
        days = days.where(F.col("event_date") >= F.lit(since))
    return days.groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"))


def day_counts(spark: SparkSession, path: str, since: date | None = None) -> list[tuple[date, int]]:
    """Rows of each day of the stored table (from ``since`` on), newest first.

    Parquet's own reader answers a count grouped by the day folder from the row counts in
    file footers (``PushedAggregation: [COUNT(*)]``), so no column of any row is read. The
    settings it needs hold only while the counts are collected: one row per day.
    """
    with footer_reader(spark):
        counted = counted_days(spark, path, since).orderBy(F.desc("event_date"))
        return [(r["event_date"], r["rows"]) for r in counted.collect()]


def read_trades_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    start: datetime,
    end: datetime,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Trades from a database, read in ``partitions`` parallel time slices.

    Rows outside start and end are not lost: they fall into the first and last slice.
    """
    rows = (
        spark.read.format("jdbc")
        .options(**options)
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", "event_time")
        .option("lowerBound", start.isoformat(sep=" "))
        .option("upperBound", end.isoformat(sep=" "))
        .option("numPartitions", partitions)
        .load()
    )
    return rows.select(
        *[F.col(field.name).cast(field.dataType).alias(field.name) for field in TRADE.fields]
    )


def _by_day(trades: DataFrame) -> DataFrame:
    """Group rows by day before writing, so that each day gets few files.

    The rebalance hint lets adaptive execution split a day that is too large for
    one task and join small ones, which a plain repartition by day would not.
    """
    stored = trades.select(
        *[F.col(field.name).cast(field.dataType).alias(field.name) for field in TRADE.fields]
    )
    return stored.withColumn("event_date", F.to_date("event_time")).hint("rebalance", "event_date")


def _write_counted(days: DataFrame, path: str, mode: str) -> int:
    # The count is taken in the writing stage itself: no second pass over the
    # rows, and a repeated map task is not counted twice.
    counted = Observation()
    (
        days.observe(counted, F.count(F.lit(1)).alias("rows"))
        .write.mode(mode)
        # Overwriting must drop every day of the old batch, whatever the session says.
        .option("partitionOverwriteMode", "static")
        .partitionBy("event_date")
        .parquet(path)
    )
    return counted.get["rows"]


def append_trades(trades: DataFrame, path: str) -> int:
    """Append a batch of valid trades and return its size. An empty one is fine."""
    return _write_counted(_by_day(trades), path, "append")


def append_batch(trades: DataFrame, path: str, batch_id: int) -> int:
    """Append a numbered batch. Sending it again replaces it, so it never doubles.

    Fits ``foreachBatch``, and the retry of a batch whose first try failed midway.
    """
    return _write_counted(_by_day(trades), f"{path}/batch_id={batch_id}", "overwrite")


def append_with_retry(trades: DataFrame, path: str, batch_id: int) -> int:
    """Append a numbered batch, once more if it fails. A second failure is raised."""
    try:
        return append_batch(trades, path, batch_id)
    except Exception:
        logging.getLogger(__name__).exception("batch %s failed, trying again", batch_id)
        return append_batch(trades, path, batch_id)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Trades written by ``append_batch``."""
    schema = T.StructType([*STORED.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).parquet(path)


def compact_batches(spark: SparkSession, source: str, target: str, upto: int) -> int:
    """Rewrite the batches up to ``upto`` into a table by day, in fewer, larger files."""
    closed = read_batches(spark, source).where(F.col("batch_id") <= upto)
    return _write_counted(_by_day(closed.select(*TRADE_COLUMNS)), target, "overwrite")
