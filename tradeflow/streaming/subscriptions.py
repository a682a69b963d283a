"""Ticks for subscribers who may change ticker and tick length at any time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.candles import tick_message
from ..operators.latest import latest, newest_requests
from ..operators.quality import validate_subscriptions
from . import state
from .windows import candle_stream

# One row per ticker and tick length in use, not per subscriber.
TICK = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("tick", T.IntegerType()),
        T.StructField("bucket_end", T.TimestampType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("trades", T.LongType()),
    ]
)

# The setting of a subscriber; null once there is no valid request.
SETTING = T.StructType(
    [
        T.StructField("sub_id", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("tick", T.IntegerType()),
    ]
)

PRICE = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("event_id", T.StringType()),
    ]
)

# Re-reads the subscriptions: a join with a table read once at the start of the
# stream would never see a later request.
Reader = Callable[[SparkSession], DataFrame]


def valid_requests(subscriptions: DataFrame) -> DataFrame:
    """The newest request of each subscriber, after the invalid ones are dropped."""
    return newest_requests(validate_subscriptions(subscriptions)[0])


def _merged() -> list[Column]:
    return [
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("trades").alias("trades"),
    ]


def merge_seconds(seconds: DataFrame, settings: DataFrame) -> DataFrame:
    """One-second candles merged to every tick length in use for their ticker.

    Every whole-second tick is a union of seconds, so merging is exact. It is
    done once per ticker and length: its cost does not grow with the number of
    subscribers, however many of them follow the same ticker.
    """
    tick = F.col("tick")
    second = F.unix_seconds("bucket_start")
    return (
        seconds.join(settings.select("ticker", "tick").distinct(), "ticker")
        .withColumn("bucket_end", F.timestamp_seconds((F.floor(second / tick) + 1) * tick))
        .groupBy("ticker", "tick", "bucket_end")
        .agg(*_merged())
        .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TICK.fields])
    )


def changed_settings(new: DataFrame, old: DataFrame) -> DataFrame:
    """Subscribers whose setting is not what it was; null if they have none any more."""
    before = old.select("sub_id", F.struct("ticker", "tick").alias("_old"))
    after = new.select("sub_id", F.struct("ticker", "tick").alias("_new"))
    both = before.join(after, "sub_id", "full")
    changed = both.where(~F.col("_old").eqNullSafe(F.col("_new")))
    return changed.select("sub_id", "_new.ticker", "_new.tick")


def start_ticks(
    trades: DataFrame,
    subscriptions: Reader,
    out: str,
    checkpoint: str,
    delay: str,
    every: str | None = None,
) -> StreamingQuery:
    """Write partial ticks per batch, and which subscribers changed their setting.

    A changed request holds for the seconds that close after it is read.
    """

    def step(seconds: DataFrame, batch_id: int) -> None:
        spark = seconds.sparkSession
        names = [field.name for field in SETTING.fields]
        state.write_batch(valid_requests(subscriptions(spark)).select(*names), f"{out}/now", batch_id)
        # Read back, so that ticks and changes are both made from the same requests.
        settings = state.read_batch(spark, SETTING, f"{out}/now", batch_id)
        old = (
            state.read_batch(spark, SETTING, f"{out}/now", batch_id - 1)
            if batch_id > 0
            else spark.createDataFrame([], SETTING)
        )
        state.write_batch(changed_settings(settings, old), f"{out}/settings", batch_id)
        state.write_batch(merge_seconds(seconds, settings), f"{out}/ticks", batch_id)
        state.forget_before(spark, f"{out}/now", batch_id - 1)

    return state.start_batches(candle_stream(trades, "1 second", delay), step, checkpoint, every)


def setting_spans(spark: SparkSession, out: str) -> DataFrame:
    """From which batch to before which batch each setting held."""
    changes = state.read_all(spark, SETTING, f"{out}/settings")
    of_subscriber = Window.partitionBy("sub_id").orderBy("batch_id")
    spans = changes.withColumn("until", F.lead("batch_id").over(of_subscriber))
    return spans.where(F.col("ticker").isNotNull()).withColumnRenamed("batch_id", "since")


def _held(ticks: DataFrame, spans: DataFrame) -> DataFrame:
    batch = F.col("batch_id")
    return ticks.join(spans, ["ticker", "tick"]).where(
        (batch >= F.col("since")) & (F.col("until").isNull() | (batch < F.col("until")))
    )


def read_ticks(spark: SparkSession, out: str, sub_id: str | None = None) -> DataFrame:
    """The ticks of one subscriber, or of all of them."""
    spans = setting_spans(spark, out)
    if sub_id is not None:
        spans = spans.where(F.col("sub_id") == sub_id)
    ticks = state.read_all(spark, TICK, f"{out}/ticks")
    return _held(ticks, spans).groupBy("sub_id", "ticker", "tick", "bucket_end").agg(*_merged())


def followers(spark: SparkSession, out: str) -> DataFrame:
    """How many subscribers had each setting in each batch with ticks or changes.

    A running sum of arrivals and leavings, which stays linear in their number.
    """
    spans = setting_spans(spark, out)
    came = spans.select("ticker", "tick", F.col("since").alias("batch_id"), F.lit(1).alias("step"))
    left = spans.where(F.col("until").isNotNull()).select(
        "ticker", "tick", F.col("until").alias("batch_id"), F.lit(-1).alias("step")
    )
    seen = state.read_all(spark, TICK, f"{out}/ticks").select(
        "ticker", "tick", "batch_id", F.lit(0).alias("step")
    )
    steps = came.unionByName(left).unionByName(seen).groupBy("ticker", "tick", "batch_id").agg(
        F.sum("step").alias("step")
    )
    so_far = Window.partitionBy("ticker", "tick").orderBy("batch_id")
    counted = steps.withColumn("subscribers", F.sum("step").over(so_far))
    return counted.drop("step")


def read_shared_ticks(spark: SparkSession, out: str) -> DataFrame:
    """Each tick once, with the number of subscribers who had chosen it at its end."""
    ticks = state.read_all(spark, TICK, f"{out}/ticks")
    joined = ticks.join(followers(spark, out), ["ticker", "tick", "batch_id"])
    return joined.groupBy("ticker", "tick", "bucket_end").agg(
        F.max_by("subscribers", "batch_id").alias("subscribers"), *_merged()
    )


# Newest price, sent every tick even if it has not changed.


def start_prices(
    trades: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Keep the newest price of every ticker; each batch writes all of them anew."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch).select(*[F.col(f.name).cast(f.dataType) for f in PRICE.fields])
        if batch_id > 0:
            fresh = latest(fresh.unionByName(state.read_batch(spark, PRICE, path, batch_id - 1)))
        state.write_batch(fresh, path, batch_id)
        # A reader may still hold the state before the last one.
        state.forget_before(spark, path, batch_id - 2)

    return state.start_batches(trades, step, checkpoint, every)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Newest price of every ticker after the last finished batch."""
    done = state.finished_batches(spark, path)
    if not done:
        return spark.createDataFrame([], PRICE)
    return state.read_batch(spark, PRICE, path, done[-1])


def due_messages(
    subscriptions: DataFrame, prices: DataFrame, first: int, last: int
) -> DataFrame:
    """Messages due in the seconds first to last, each subscriber at its own tick."""
    tick = F.col("tick").cast("long")
    start = F.ceil(F.lit(first) / tick) * tick
    due = (
        valid_requests(subscriptions)
        .where(start <= last)
        .withColumn("due", F.explode(F.sequence(start, F.lit(last).cast("long"), tick)))
    )
    joined = due.join(prices.select("ticker", "price"), "ticker", "left")
    return joined.select(
        "sub_id", F.timestamp_seconds("due").alias("due"), *tick_message("price", "price")
    )


def start_sampler(
    spark: SparkSession,
    prices: str,
    subscriptions: Reader,
    out: str,
    checkpoint: str,
    every: str = "1 second",
) -> StreamingQuery:
    """Send the newest price to every subscriber whose tick is due.

    Driven by a clock stream, since a trade stream is silent when nobody trades.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def step(batch: DataFrame, batch_id: int) -> None:
        second = F.unix_seconds("timestamp")
        span = batch.agg(F.min(second).alias("first"), F.max(second).alias("last")).first()
        if span["first"] is None:
            return
        session = batch.sparkSession
        sent = due_messages(
            subscriptions(session), read_prices(session, prices), span["first"], span["last"]
        )
        state.write_batch(sent, out, batch_id)

    return state.start_batches(clock, step, checkpoint, every)


def sample_span(
    spark: SparkSession,
    prices: str,
    subscriptions: Reader,
    out: str,
    checkpoint: str,
    first: int,
    seconds: int,
    per_batch: int = 60,
) -> StreamingQuery:
    """``start_sampler`` on a clock that does not read the wall clock: seconds ``first`` to
    ``first + seconds - 1``, ``per_batch`` seconds a micro-batch, then the query stops.

    The ``rate-micro-batch`` source gives micro-batch k the time first + k * per_batch,
    whenever it runs, so a batch run again after a failure sends the same messages; each
    batch reads the newest finished version of the price state at ``prices``.
    """
    if seconds <= 0 or per_batch <= 0:
        raise ValueError("a span and a batch need at least one second")
    end = first + seconds
    clock = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", 1)
        .option("startTimestamp", first * 1000)
        .option("advanceMillisPerBatch", per_batch * 1000)
        .load()
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        tick = batch.agg(F.min(F.unix_seconds("timestamp")).alias("tick")).first()["tick"]
        if tick is None or tick >= end:
            return
        session = batch.sparkSession
        sent = due_messages(
            subscriptions(session), read_prices(session, prices), tick, min(tick + per_batch, end) - 1
        )
        state.write_batch(sent, out, batch_id)

    query = (
        clock.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime="0 seconds")
        .start()
    )
    batches = -(-seconds // per_batch)
    while query.isActive and len([b for b in state.finished_batches(spark, out) if b < batches]) < batches:
        query.awaitTermination(0.2)
    if query.isActive:
        query.stop()
    if query.exception() is not None:
        raise query.exception()
    return query
