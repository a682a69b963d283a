"""Price candles per bucket, their roll-up to wider buckets, and their gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bucket_start, exact_total, interval, interval_seconds, price_cents


def tick_candles(trades: DataFrame, width: str) -> DataFrame:
    """Highest and lowest price per ticker and bucket, for ticks of 1 to 60 seconds."""
    return (
        trades.withColumn("bucket_start", bucket_start("event_time", width))
        .groupBy("ticker", "bucket_start")
        .agg(*tick_measures())
    )


def tick_measures() -> list[Column]:
    return [
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.count(F.lit(1)).alias("trades"),
    ]


def tick_message(high: str = "high", low: str = "low", tick: str = "tick") -> list[Column]:
    """The columns of a tick message. Without a price, ``data`` is null."""
    data = F.struct(
        F.col(high).cast("double").alias("high"), F.col(low).cast("double").alias("low")
    )
    return [
        F.lit("candle_tick").alias("type"),
        F.col("ticker"),
        F.when(F.col(high).isNotNull(), data).alias("data"),
        F.col(tick).cast("int").alias("current_tick"),
    ]


def candles(trades: DataFrame, width: str) -> DataFrame:
    """Open, high, low, close, volume, trades and money per ticker and bucket.

    All measures can be merged further: ``first_key`` and ``last_key`` say which
    trade gave the open and the close, ``cents`` is the exact money volume.
    """
    return (
        trades.withColumn("bucket_start", bucket_start("event_time", width))
        .groupBy("ticker", "bucket_start")
        .agg(*candle_measures())
    )


def candle_measures() -> list[Column]:
    """The measures of ``candles`` over trades, for batches and streams."""
    when = F.struct("event_time", "event_id")
    return [
        F.min_by("price", when).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", when).alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
        exact_total(price_cents() * F.col("volume")).alias("cents"),
        F.min(when).alias("first_key"),
        F.max(when).alias("last_key"),
    ]


def roll_up(fine: DataFrame, width: str, fine_width: str | None = None) -> DataFrame:
    """Candles of a wider bucket from finer ones, without reading trades again.

    ``width`` must be a multiple of the finer width; it is checked if that is given.
    """
    if fine_width is not None and interval_seconds(width) % interval_seconds(fine_width):
        raise ValueError(f"{width} is no multiple of {fine_width}")
    return (
        fine.withColumn("bucket_start", bucket_start("bucket_start", width))
        .groupBy("ticker", "bucket_start")
        .agg(*roll_up_measures())
    )


def roll_up_measures() -> list[Column]:
    """The measures of ``roll_up`` over finer candles, for batches and streams."""
    return [
        F.min_by("open", "first_key").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last_key").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trades").alias("trades"),
        F.sum("cents").cast("decimal(38,0)").alias("cents"),
        F.min("first_key").alias("first_key"),
        F.max("last_key").alias("last_key"),
    ]


def candle_report(merged: DataFrame) -> DataFrame:
    """Candles as shown to a reader, with money and average price per share."""
    money = F.col("cents").cast("double") / 100
    return merged.select(
        "ticker",
        "bucket_start",
        "open",
        "high",
        "low",
        "close",
        "volume",
        "trades",
        money.alias("notional"),
        F.round(money / F.col("volume"), 6).alias("vwap"),
    )


def calendar(spans: DataFrame, width: str) -> DataFrame:
    """One row per bucket from ``first`` to ``last``, for every row of ``spans``.

    Blocks of about a day are listed first and spread over the tasks, then the
    buckets of each block, so that neither an array nor a task has to hold a
    whole long span. A width need not divide a day: blocks are whole buckets.
    """
    step, block = interval(width), interval(width) * max(1, 86400 // interval_seconds(width))
    tasks = spans.sparkSession.sparkContext.defaultParallelism
    names = [name for name in spans.columns if name not in ("first", "last")]
    blocks = spans.withColumn("_block", F.explode(F.sequence("first", "last", block)))
    end = F.least("last", F.col("_block") + block - step)
    return blocks.repartition(tasks, *names, "_block").select(
        *names, F.explode(F.sequence("_block", end, step)).alias("bucket_start")
    )


def ticker_spans(trades: DataFrame, width: str) -> DataFrame:
    """First and last bucket of every ticker, from two columns of the trades."""
    spans = trades.groupBy("ticker").agg(
        F.min("event_time").alias("first"), F.max("event_time").alias("last")
    )
    # One window expression per projection is all that Spark takes.
    for name in ("first", "last"):
        spans = spans.withColumn(name, bucket_start(name, width))
    return spans


def fill_gaps(found: DataFrame, width: str, spans: DataFrame) -> DataFrame:
    """All buckets of a ticker from ``first`` to ``last`` of its row in ``spans``.

    Those without trades have null measures, so that missing data can be seen.
    """
    buckets = calendar(spans.select("ticker", "first", "last"), width).select(
        "ticker", "bucket_start"
    )
    return buckets.join(found, ["ticker", "bucket_start"], "left")


def gap_spans(found: DataFrame, width: str, chunk: str = "1 day") -> DataFrame:
    """Runs of buckets without trades between the first and last bucket of each ticker.

    One row per run: ``gap_start`` and ``gap_end`` are its first and last missing bucket,
    ``buckets`` their number, so the output grows with the gaps and not with the calendar.
    ``found`` has a row per (ticker, bucket_start) with trades. Each bucket meets the next
    by ``lead`` within its ticker and ``chunk`` of time, so no task holds a whole hot
    ticker; the last bucket of a chunk meets the first of the next chunk that has any,
    from one summary row per chunk. Expanded, the runs are the buckets with null measures
    of ``fill_gaps``.
    """
    seconds = interval_seconds(width)
    step = interval(width)
    buckets = found.select("ticker", "bucket_start").withColumn("_chunk", bucket_start("bucket_start", chunk))
    inner = buckets.withColumn(
        "_next", F.lead("bucket_start").over(Window.partitionBy("ticker", "_chunk").orderBy("bucket_start"))
    )
    within = inner.where(F.col("_next").isNotNull()).select("ticker", "bucket_start", "_next")
    chunks = buckets.groupBy("ticker", "_chunk").agg(
        F.min("bucket_start").alias("_first"), F.max("bucket_start").alias("_last")
    )
    carried = chunks.withColumn("_next", F.lead("_first").over(Window.partitionBy("ticker").orderBy("_chunk")))
    across = carried.where(F.col("_next").isNotNull()).select(
        "ticker", F.col("_last").alias("bucket_start"), "_next"
    )
    missing = F.timestamp_diff("SECOND", F.col("bucket_start"), F.col("_next")) / seconds - 1
    return (
        within.unionByName(across)
        .where(missing >= 1)
        .select(
            "ticker",
            (F.col("bucket_start") + step).alias("gap_start"),
            (F.col("_next") - step).alias("gap_end"),
            missing.cast("long").alias("buckets"),
        )
    )
