"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, candles, changes, health, history, latest, quality
from ..operators.history import HistoryQuery, TimeRange
from ..session import work_dir
from ..sources import (
    append_trades,
    append_with_retry,
    customers_as_subscriptions,
    day_counts,
    events_as_trades,
    export_json,
    lineitem_as_trades,
    orders_as_change_feed,
    orders_as_requests,
    parse_changes,
    read_batches,
    read_changes,
    read_trades,
    split_changes,
)
from ..streaming import anomaly as stream_rules
from ..streaming import price_state
from ..streaming import changes as stream_changes
from ..streaming import state, stored_dedup, subscriptions, windows

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = datetime(2024, 1, 31)
DELAY = "10 minutes"
# Parts in which a stream arrives, and how far trades come out of order, below DELAY.
DELIVERIES = 6
MIXED_SECONDS = 540
# Far below the default, so that even small tables take the path for huge keys.
FEW_ROWS = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_trades(spark: SparkSession, sf_dir: str, zoned: bool = False) -> DataFrame:
    return events_as_trades(_table(spark, sf_dir, "events"), zoned)


def _line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_as_trades(_table(spark, sf_dir, "lineitem"))


def _subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers_as_subscriptions(_table(spark, sf_dir, "customer"))


def trade_stream(spark: SparkSession, sf_dir: str, kind: str = "mixed") -> DataFrame:
    """Trades that arrive in several deliveries, one for each micro-batch.

    Each brings the trades of a span of time, mixed at its ends with those of its
    neighbours by less than DELAY. Of the kind "twice", each trade comes again in the
    next one; of the kind "late", every tenth comes in one more at the end.
    """
    trades = event_trades(spark, sf_dir, zoned=True)
    second = F.unix_seconds("event_time")
    span = trades.agg(F.min(second).alias("first"), F.max(second).alias("last")).first()
    first, length = span["first"] or 0, (span["last"] or 0) - (span["first"] or 0) + MIXED_SECONDS + 1
    shift = F.pmod(F.xxhash64("event_id"), F.lit(MIXED_SECONDS))
    number = F.floor((second - first + shift) * DELIVERIES / length)
    numbers = {
        "mixed": F.array(number),
        "twice": F.array(number, number + 1),
        "late": F.array(F.when(F.col("event_id").cast("long") % 10 == 0, DELIVERIES).otherwise(number)),
    }
    sent = trades.withColumn("delivery", F.explode(numbers[kind]))
    place, parts = work_dir(spark, "feed"), spark.sparkContext.defaultParallelism
    for k in range(DELIVERIES + (kind != "mixed")):  # files are read in the order of their times
        one = sent.where(F.col("delivery") == k).drop("delivery")
        one.repartition(parts).write.mode("append").parquet(place)
    return spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", parts).parquet(place)


def _unzoned(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in columns})


# Past trades.


def history_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = HistoryQuery.from_params(
        {"duration": 20 * 24 * 60, "ticker": "CLICK", "tradeType": "buy", "marketCode": "NYSE"}
    )
    return history.history(event_trades(spark, sf_dir), query, AS_OF)


def history_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All newest rows, merged in two levels as on a table with very many files."""
    return history.newest(event_trades(spark, sf_dir), history.HISTORY_LIMIT, lanes=8)


def history_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = TimeRange(datetime(2024, 1, 10), datetime(2024, 1, 12))
    return history.matching(event_trades(spark, sf_dir), span=span)


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page."""
    trades = event_trades(spark, sf_dir)
    query = HistoryQuery(ticker="VIEW")
    first = history.history_page(trades, query)
    return history.history_page(trades, query, history.next_cursor(first))


def history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = HistoryQuery(duration=20 * 24 * 60, trade_type="SELL")
    return history.summary(event_trades(spark, sf_dir), query, AS_OF).select("*", "filters.*").drop(
        "filters"
    )


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a preview shows, and how many of them the table really has."""
    trades = event_trades(spark, sf_dir)
    shown = history.preview(trades).select("event_id", F.lit(1).alias("shown"))
    # The preview is the fixed-size side.
    found = trades.select("event_id", F.lit(1).alias("found")).join(
        F.broadcast(shown), "event_id"
    )
    return found.agg(F.sum("shown").alias("shown"), F.sum("found").alias("found"))


def history_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by day, then read back through the day filter, newest days only."""
    path = work_dir(spark, "trades")
    append_trades(event_trades(spark, sf_dir, zoned=True), path)
    span = TimeRange(datetime(2024, 1, 10, 6), datetime(2024, 1, 12, 18))
    found = history.matching(read_trades(spark, path), HistoryQuery(market_code="AMEX"), span=span)
    newest = history.newest(found, 150, by_day=True).drop("event_date")
    return _unzoned(newest.withColumn("price", F.col("price").cast("double")), "event_time")


def history_newest_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 150 newest trades of the stored table; its days counted from file footers."""
    path = work_dir(spark, "trades_newest")
    append_trades(event_trades(spark, sf_dir, zoned=True), path)
    days = day_counts(spark, path)
    newest = history.newest(read_trades(spark, path), 150, days=days).drop("event_date")
    return _unzoned(newest.withColumn("price", F.col("price").cast("double")), "event_time")


def append_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, one of them sent twice; nothing is doubled."""
    trades = event_trades(spark, sf_dir, zoned=True)
    path = work_dir(spark, "batches")
    for batch_id in (0, 1, 1):
        append_with_retry(trades.where(F.col("event_id") % 2 == batch_id), path, batch_id)
    return (
        read_batches(spark, path)
        .groupBy("batch_id", "event_date")
        .agg(F.count(F.lit(1)).alias("trades"), F.sum("volume").alias("volume"))
    )


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = event_trades(spark, sf_dir).withColumn("price", F.col("price").cast("decimal(10,2)"))
    return export_json(trades)


# Row rules.


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quality.check(_line_trades(spark, sf_dir), quality.trade_rules(uuids=False))
    return checked.groupBy(F.concat_ws(",", "violations").alias("violations")).agg(
        F.count(F.lit(1)).alias("trades")
    )


def quality_gate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of which most break a rule, by their number; every rule is broken by some."""
    number = F.col("event_id").cast("long")
    kind = F.col("number") % 12

    def damaged(name: str, **values: Column) -> Column:
        value = F.col(name)
        for key, bad in values.items():
            value = F.when(kind == int(key[1:]), bad).otherwise(value)
        return value

    identity = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))
    whole = event_trades(spark, sf_dir).withColumns(
        {"number": number, "event_id": identity, "trade_id": identity}
    )
    raw = whole.select(
        "number",
        damaged("event_time", k0=F.lit(None)).alias("event_time"),
        damaged("event_id", k1=F.lit("x")).alias("event_id"),
        damaged("ticker", k2=F.lit("ELEVENCHARS"), k10=F.lit("")).alias("ticker"),
        damaged("price", k3=F.lit(0.0), k4=F.lit(10000.01)).alias("price"),
        damaged("volume", k5=F.lit(0), k6=F.lit(1000001)).alias("volume"),
        damaged("trade_type", k7=F.lit("HOLD")).alias("trade_type"),
        damaged("trade_id", k8=F.replace("trade_id", F.lit("-"), F.lit(""))).alias("trade_id"),
        damaged("market_code", k9=F.lit("A MARKET CODE TOO LONG")).alias("market_code"),
        damaged("currency_code", k10=F.lit("US")).alias("currency_code"),
    )
    checked = quality.check(raw, quality.trade_rules())
    return checked.select("number", F.concat_ws(",", "violations").alias("violations"))


def quality_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = quality.validate_trades(_line_trades(spark, sf_dir), uuids=False)
    return valid.drop("event_id")


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = event_trades(spark, sf_dir).withColumns(
        {"ticker": F.lower("ticker"), "currency_code": F.lower("currency_code")}
    )
    return quality.normalize_trades(raw).withColumn("price", F.col("price").cast("double"))


def normalize_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices between two cents, every other one just half-way."""
    number = F.col("event_id").cast("long") % 16
    between = F.when(number % 2 == 0, number / 16).otherwise(number / 500)
    raw = event_trades(spark, sf_dir).withColumn("price", F.floor("price") + between)
    rounded = quality.normalize_trades(raw).withColumn("price", F.col("price").cast("double"))
    return rounded.select("trade_id", "price")


def check_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from every shipment on, some backwards, empty or too long."""
    ranges = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").cast("timestamp").alias("start"),
        F.expr("timestampadd(DAY, l_orderkey % 60 - 15, cast(l_shipdate AS timestamp))").alias("end"),
    )
    checked = quality.check_ranges(ranges)
    return checked.select("l_orderkey", "l_linenumber", F.concat_ws(",", "violations").alias("violations"))


def check_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quality.check_requests(orders_as_requests(_table(spark, sf_dir, "orders")))
    return checked.withColumn("violations", F.concat_ws(",", "violations"))


def check_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quality.check_subscriptions(_subscriptions(spark, sf_dir))
    shown = checked.withColumn("violations", F.concat_ws(",", "violations"))
    return _unzoned(shown, "updated_at")


# Prices and candles.


def latest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest(event_trades(spark, sf_dir))


def latest_for_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = quality.validate_subscriptions(_subscriptions(spark, sf_dir))[0]
    sent = latest.messages(requests, latest.latest(event_trades(spark, sf_dir)))
    return sent.select("sub_id", "type", "ticker", "data.high", "data.low", "current_tick")


def _tick_query(width: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return candles.tick_candles(event_trades(spark, sf_dir), width)

    return run


def _candle_query(width: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return candles.candle_report(candles.candles(event_trades(spark, sf_dir), width))

    return run


def tick_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-second candles in the form that is sent to a client."""
    found = candles.tick_candles(event_trades(spark, sf_dir), "5 seconds")
    sent = found.withColumn("tick", F.lit(5)).select("bucket_start", *candles.tick_message())
    return sent.select("bucket_start", "type", "ticker", "data.high", "data.low", "current_tick")


def candles_line_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.tick_candles(_line_trades(spark, sf_dir), "1 day")


def candles_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = candles.candles(event_trades(spark, sf_dir), "1 minute")
    return candles.candle_report(candles.roll_up(candles.roll_up(minutes, "1 hour", "1 minute"), "1 day", "1 hour"))


def candle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = event_trades(spark, sf_dir)
    found = candles.tick_candles(trades, "10 minutes")
    return candles.fill_gaps(found, "10 minutes", candles.ticker_spans(trades, "10 minutes"))


def candle_gap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of 10-minute buckets without trades, one row per run."""
    found = candles.tick_candles(event_trades(spark, sf_dir), "10 minutes")
    return candles.gap_spans(found, "10 minutes")


# Unusual trades.


def _flat(found: DataFrame, *evidence: str) -> DataFrame:
    return found.select(
        "event_type",
        "event_time",
        "ticker",
        "rule",
        F.round("score", 6).alias("score"),
        *[F.round(F.col("evidence")[name], 6).alias(name) for name in evidence],
    )


def anomaly_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(anomaly.price_zscore(event_trades(spark, sf_dir)), "price", "mean", "deviation")


def anomaly_zscore_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule with every ticker treated as too large for one task."""
    found = anomaly.price_zscore(event_trades(spark, sf_dir), rows_per_task=FEW_ROWS)
    return _flat(found, "price", "mean", "deviation")


def anomaly_null_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the trades of one ticker without it, which make a series of their own."""
    trades = event_trades(spark, sf_dir).withColumn("ticker", F.nullif("ticker", F.lit("CLICK")))
    return _flat(anomaly.price_zscore(trades, rows_per_task=FEW_ROWS), "price", "mean", "deviation")


def anomaly_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(anomaly.price_jump(event_trades(spark, sf_dir), 5.0), "price", "previous")


def anomaly_jump_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomaly.price_jump(event_trades(spark, sf_dir), 5.0, FEW_ROWS)
    return _flat(found, "price", "previous")


def anomaly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(anomaly.volume_spike(event_trades(spark, sf_dir), "1 hour"), "volume", "mean")


def anomaly_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(anomaly.trade_burst(event_trades(spark, sf_dir), "1 hour", 5), "trades", "limit")


def anomaly_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(anomaly.price_range(event_trades(spark, sf_dir), "1 hour", 50.0), "high", "low")


def anomaly_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = anomaly.Limits(jump=5.0, burst=5, range=50.0)
    found = anomaly.all_rules(event_trades(spark, sf_dir), "1 hour", limits, FEW_ROWS)
    return _flat(found)


def anomaly_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of two tickers in a span of time, as framed text."""
    found = anomaly.trade_burst(event_trades(spark, sf_dir), "1 hour", 5)
    chosen = anomaly.select_anomalies(
        found, ["CLICK", "VIEW"], ["burst"], datetime(2024, 1, 5), datetime(2024, 1, 25)
    )
    return anomaly.as_messages(chosen, framed=True)


def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the trades that pass a stricter price bound, rejected ones counted."""
    trades = event_trades(spark, sf_dir)
    good = trades.where(F.col("price") <= 100)
    found = anomaly.trade_burst(trades, "1 hour", 5)
    return health.health(
        health.arrivals(good, "10 minutes"),
        "10 minutes",
        found,
        trades.where(F.col("price") > 100),
        slow="5 minutes",
    )


# Change feed.


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_as_change_feed(_table(spark, sf_dir, "orders"))


def changes_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable, _ = split_changes(parse_changes(_feed(spark, sf_dir)))
    return _unzoned(changes.apply_changes(usable), "event_time")


def changes_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current trades from a feed whose prices come as two's complement bytes (scale 2)."""
    feed = orders_as_change_feed(_table(spark, sf_dir, "orders"), binary_scale=2)
    usable, _ = split_changes(parse_changes(feed, {"price": 2}))
    return _unzoned(changes.apply_changes(usable), "event_time")


def changes_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message cut short, altered or emptied on its way, with the reason."""
    order = F.floor(F.regexp_extract("value", '"ts_ms":([0-9]+)', 1).cast("long") / 10)
    feed = _feed(spark, sf_dir).withColumn("kind", order % 4)
    damaged = feed.select(
        F.when(F.col("kind") == 0, F.expr("left(value, 20)"))
        .when(F.col("kind") == 1, F.regexp_replace("value", '"ts_ms":[0-9]+', '"ts_ms":null'))
        .when(F.col("kind") == 2, F.regexp_replace("value", '"op":"[a-z]"', '"op":"x"'))
        .alias("value")
    )
    _, rejected = split_changes(parse_changes(damaged))
    return rejected.groupBy("problem").agg(F.count(F.lit(1)).alias("messages"))


def changes_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of all orders as they began, with only later changes in the feed."""
    usable, _ = split_changes(parse_changes(_feed(spark, sf_dir)))
    begun = usable.where(F.col("op") == "c").select("after.*")
    later = usable.where(F.col("op") != "c")
    return _unzoned(changes.bootstrap(begun, later), "event_time")


def copies_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = event_trades(spark, sf_dir)
    twice = trades.unionByName(trades.where(F.col("ticker") == "CLICK"))
    return changes.without_copies(twice)


# Streams, run over the files that are there.


def stream_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = work_dir(spark, "candles")
    stream = windows.candle_stream(trade_stream(spark, sf_dir), "60 seconds", DELAY)
    state.finish(state.start(stream, f"{place}/out", f"{place}/checkpoint"))
    closed = spark.read.schema(stream.schema).parquet(f"{place}/out")
    return _unzoned(closed, "bucket_start")


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day candles of a stream through minute and hour windows in one query: closed days."""
    place = work_dir(spark, "rollup")
    stream = windows.rollup_stream(trade_stream(spark, sf_dir), ["1 minute", "1 hour", "1 day"], DELAY)
    state.finish(state.start(stream, f"{place}/out", f"{place}/checkpoint"))
    closed = spark.read.schema(stream.schema).parquet(f"{place}/out")
    return _unzoned(candles.candle_report(closed), "bucket_start")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = work_dir(spark, "dedup")
    trades = trade_stream(spark, sf_dir, "twice")
    twice = trades.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    stream = windows.distinct_trades(twice, "1 day", salted=True)
    state.finish(state.start(stream, f"{place}/out", f"{place}/checkpoint"))
    return _unzoned(spark.read.schema(stream.schema).parquet(f"{place}/out"), "event_time")


def stream_dedup_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade comes twice, the copy a delivery later, far behind any watermark."""
    place = work_dir(spark, "dedup_stored")
    trades = trade_stream(spark, sf_dir, "twice")
    state.finish(stored_dedup.start_stored_dedup(trades, f"{place}/out", f"{place}/checkpoint"))
    return _unzoned(stored_dedup.read_stored(spark, trades.schema, f"{place}/out"), "event_time")


def stream_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = work_dir(spark, "ticks")
    query = subscriptions.start_ticks(
        trade_stream(spark, sf_dir),
        lambda session: _subscriptions(session, sf_dir),
        f"{place}/out",
        f"{place}/checkpoint",
        DELAY,
    )
    state.finish(query)
    return _unzoned(subscriptions.read_shared_ticks(spark, f"{place}/out"), "bucket_end")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = work_dir(spark, "prices")
    query = subscriptions.start_prices(
        trade_stream(spark, sf_dir), f"{place}/out", f"{place}/checkpoint"
    )
    state.finish(query)
    return _unzoned(subscriptions.read_prices(spark, f"{place}/out"), "event_time")


def stream_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages due to all subscribers in one minute after the last trade.

    Prices come from the price state a trade stream keeps; the sampler runs on a clock
    that starts at that minute, 20 seconds a micro-batch.
    """
    place = work_dir(spark, "sampler")
    state.finish(subscriptions.start_prices(trade_stream(spark, sf_dir), f"{place}/prices", f"{place}/prices_cp"))
    start = (AS_OF - datetime(1970, 1, 1)) // timedelta(seconds=1)
    subscriptions.sample_span(
        spark, f"{place}/prices", lambda session: _subscriptions(session, sf_dir),
        f"{place}/out", f"{place}/checkpoint", start, 60, per_batch=20,
    )
    sent = spark.read.parquet(f"{place}/out").drop("batch_id")
    return _unzoned(sent, "due").select(
        "sub_id", "due", "type", "ticker", "data.high", "data.low", "current_tick"
    )


def stream_changes_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = work_dir(spark, "changes")
    _feed(spark, sf_dir).repartition(8).write.text(f"{place}/feed")
    raw = read_changes(spark, path=f"{place}/feed", maxFilesPerTrigger="3")
    state.finish(stream_changes.start_changes(raw, f"{place}/out", f"{place}/checkpoint"))
    return _unzoned(stream_changes.read_current(spark, f"{place}/out"), "event_time")


def _rule_stream(name: str, zscore: float | None, jump: float | None, *evidence: str) -> Query:
    """Price rules of a stream whose rows wait in Spark's state store for the watermark."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        place = work_dir(spark, name)
        query = price_state.start_price_rules(
            trade_stream(spark, sf_dir), f"{place}/out", f"{place}/checkpoint", "12 hours",
            zscore=zscore, jump=jump,
        )
        state.finish(query)
        found = price_state.read_anomalies(spark, f"{place}/out")
        return _unzoned(_flat(found, *evidence), "event_time")

    return run


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The z-score of a stream whose late trades no rule sees."""
    found = price_state.read_anomalies(spark, _with_late_trades(spark, sf_dir))
    return _unzoned(_flat(found, "price", "mean", "deviation"), "event_time")


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late trades of the same stream, which are kept apart, by ticker.

    Spark's stateful processor drops rows older than the watermark of the batch before
    before it sees them, so only the rows between that and the present watermark reach
    ``price_state.read_late``. All late rows, by ticker, come from the rules kept in
    per-batch folders.
    """
    place = work_dir(spark, "late_rows")
    trades, rule = trade_stream(spark, sf_dir, "late"), stream_rules.price_rules(jump=None)
    state.finish(stream_rules.start_rules(trades, rule, f"{place}/out", f"{place}/checkpoint", "12 hours"))
    late = spark.read.parquet(f"{place}/out/late")
    return late.groupBy("ticker").agg(F.count(F.lit(1)).alias("late"))


def _with_late_trades(spark: SparkSession, sf_dir: str) -> str:
    place = work_dir(spark, "late")
    trades = trade_stream(spark, sf_dir, "late")
    query = price_state.start_price_rules(
        trades, f"{place}/out", f"{place}/checkpoint", "12 hours", jump=None
    )
    state.finish(query)
    return f"{place}/out"


def stream_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = work_dir(spark, "volume")
    stream = windows.volume_stream(trade_stream(spark, sf_dir), "1 hour", DELAY)
    rule = stream_rules.volume_rules()
    query = stream_rules.start_rules(stream, rule, f"{place}/out", f"{place}/checkpoint", None)
    state.finish(query)
    found = stream_rules.read_anomalies(spark, f"{place}/out")
    return _unzoned(_flat(found, "volume", "mean"), "event_time")


def _window_rule(name: str, build, *evidence: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        place = work_dir(spark, name)
        stream = build(trade_stream(spark, sf_dir))
        state.finish(state.start(stream, f"{place}/out", f"{place}/checkpoint"))
        found = spark.read.schema(stream.schema).parquet(f"{place}/out")
        return _unzoned(_flat(found, *evidence), "event_time")

    return run


def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of a stream, from the closed intervals it has written."""
    place = work_dir(spark, "arrivals")
    stream = windows.arrival_stream(trade_stream(spark, sf_dir), "10 minutes", DELAY)
    state.finish(state.start(stream, f"{place}/out", f"{place}/checkpoint"))
    arrived = spark.read.schema(stream.schema).parquet(f"{place}/out")
    rows = health.health(arrived, "10 minutes", slow="5 minutes").drop("anomalies", "rejected")
    return _unzoned(rows, "bucket_start", "newest")


def stream_health_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of a stream whose trades above 100 are rejected, from one tagged aggregate."""
    place = work_dir(spark, "health_live")
    price = F.col("price")
    stream = windows.health_stream(trade_stream(spark, sf_dir), "10 minutes", DELAY, price <= 100, price > 100)
    state.finish(state.start(stream, f"{place}/out", f"{place}/checkpoint"))
    closed = spark.read.schema(stream.schema).parquet(f"{place}/out")
    arrived = closed.where(F.col("rows") > 0).select("bucket_start", "rows", "newest")
    counted = closed.where(F.col("rejected") > 0).select("bucket_start", "rejected")
    rows = health.health(arrived, "10 minutes", slow="5 minutes", rejected_counts=counted)
    return _unzoned(rows.drop("anomalies"), "bucket_start", "newest")


def queries() -> dict[str, Query]:
    return {
        "history_filter": history_filter,
        "history_merged": history_merged,
        "history_range": history_range,
        "history_page": history_page,
        "history_summary": history_summary,
        "preview": preview,
        "history_stored": history_stored,
        "history_newest_stored": history_newest_stored,
        "append_retry": append_retry,
        "export_json": export,
        "quality_gate": quality_gate,
        "quality_gate_all": quality_gate_all,
        "quality_valid": quality_valid,
        "normalize": normalize,
        "normalize_rounding": normalize_rounding,
        "check_ranges": check_ranges,
        "check_requests": check_requests,
        "check_subscriptions": check_subscriptions,
        "latest_price": latest_price,
        "latest_for_subscriptions": latest_for_subscriptions,
        "tick_candles_60s": _tick_query("60 seconds"),
        "tick_candles_7s": _tick_query("7 seconds"),
        "tick_messages": tick_messages,
        "candles_minute": _candle_query("1 minute"),
        "candles_hour": _candle_query("1 hour"),
        "candles_day": _candle_query("1 day"),
        "candles_line_day": candles_line_day,
        "candles_rollup": candles_rollup,
        "stream_rollup": stream_rollup,
        "candle_gaps": candle_gaps,
        "candle_gap_spans": candle_gap_spans,
        "anomaly_zscore": anomaly_zscore,
        "anomaly_zscore_split": anomaly_zscore_split,
        "anomaly_null_ticker": anomaly_null_ticker,
        "anomaly_jump": anomaly_jump,
        "anomaly_jump_split": anomaly_jump_split,
        "anomaly_volume": anomaly_volume,
        "anomaly_burst": anomaly_burst,
        "anomaly_range": anomaly_range,
        "anomaly_all": anomaly_all,
        "anomaly_messages": anomaly_messages,
        "stream_health": stream_health,
        "changes_current": changes_current,
        "changes_decimal": changes_decimal,
        "changes_rejected": changes_rejected,
        "changes_bootstrap": changes_bootstrap,
        "copies_removed": copies_removed,
        "stream_candles": stream_candles,
        "stream_dedup": stream_dedup,
        "stream_dedup_stored": stream_dedup_stored,
        "stream_health_live": stream_health_live,
        "stream_subscriptions": stream_subscriptions,
        "stream_latest": stream_latest,
        "stream_sampler": stream_sampler,
        "stream_changes_current": stream_changes_current,
        "stream_zscore": _rule_stream("zscore", 3.0, None, "price", "mean", "deviation"),
        "stream_jump": _rule_stream("jump", None, 5.0, "price", "previous"),
        "stream_late": stream_late,
        "stream_late_rows": stream_late_rows,
        "stream_volume": stream_volume,
        "stream_burst": _window_rule(
            "burst", lambda trades: windows.bucket_rule_stream(trades, "1 hour", DELAY, burst=5), "trades", "limit"
        ),
        "stream_range": _window_rule(
            "range", lambda trades: windows.bucket_rule_stream(trades, "1 hour", DELAY, price_range=50.0), "high", "low"
        ),
        "stream_arrivals": stream_arrivals,
    }
