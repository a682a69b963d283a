"""Queries over past trades: filters, newest rows, pages and summaries."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iso_text, same_clock
from .quality import LONGEST_RANGE, TRADE_TYPES

# Fixed value: rows of one history answer.
HISTORY_LIMIT = 1000


@dataclass(frozen=True)
class HistoryQuery:
    """Optional filters; those that are None do not restrict anything."""

    duration: int | None = None
    ticker: str | None = None
    trade_type: str | None = None
    market_code: str | None = None

    def __post_init__(self) -> None:
        if self.duration is not None:
            if isinstance(self.duration, bool) or not isinstance(self.duration, int):
                raise ValueError("duration must be a whole number of minutes")
            if self.duration < 1:
                raise ValueError("duration must be at least one minute")
        for name in ("ticker", "market_code"):
            value = getattr(self, name)
            if value is not None and not (
                isinstance(value, str) and re.fullmatch("[A-Z]+", value)
            ):
                raise ValueError(f"{name} must be upper-case English letters")
        if self.trade_type is not None:
            if not isinstance(self.trade_type, str):
                raise ValueError("tradeType must be text")
            if self.trade_type.upper() not in TRADE_TYPES:
                raise ValueError(f"tradeType must be one of {TRADE_TYPES}")
            object.__setattr__(self, "trade_type", self.trade_type.upper())

    @classmethod
    def from_params(cls, params: Mapping[str, Any]) -> HistoryQuery:
        """From camelCase request parameters. Unknown names are an error."""
        names = {
            "duration": "duration",
            "ticker": "ticker",
            "tradeType": "trade_type",
            "marketCode": "market_code",
        }
        unknown = set(params) - set(names)
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        values = {names[key]: value for key, value in params.items()}
        minutes = values.get("duration")
        if isinstance(minutes, str) and re.fullmatch(r"[+-]?[0-9]+", minutes.strip()):
            values["duration"] = int(minutes)
        return cls(**values)


@dataclass(frozen=True)
class TimeRange:
    """Half-open span start <= event_time < end, no longer than ``longest``."""

    start: datetime
    end: datetime
    longest: timedelta = LONGEST_RANGE

    def __post_init__(self) -> None:
        if self.end <= self.start:
            raise ValueError("the range must end after it starts")
        if self.end - self.start > self.longest:
            raise ValueError(f"the range is longer than {self.longest}")


@dataclass(frozen=True)
class Cursor:
    """Position of the last row of a page."""

    event_time: datetime
    event_id: Any


def _since(trades: DataFrame, query: HistoryQuery, as_of: datetime | None) -> Column:
    if as_of is not None:
        return same_clock(trades, "event_time", as_of - timedelta(minutes=query.duration))
    start = F.current_timestamp() - F.make_dt_interval(mins=F.lit(query.duration))
    return start.cast(trades.schema["event_time"].dataType)


def matching(
    trades: DataFrame,
    query: HistoryQuery = HistoryQuery(),
    as_of: datetime | None = None,
    span: TimeRange | None = None,
) -> DataFrame:
    """Trades that pass every given filter.

    The lookback has no upper end: trades stamped after ``as_of`` are included.
    On the stored table the same bounds are put on ``event_date``, because Spark
    does not derive a folder filter from a filter on ``event_time``.
    """
    daily = "event_date" in trades.columns
    time = F.col("event_time")
    tests: list[Column] = []

    def bound(test, limit: Column) -> None:
        tests.append(test(time, limit))
        if daily:
            by_day = operator.le if test in (operator.lt, operator.le) else operator.ge
            tests.append(by_day(F.col("event_date"), F.to_date(limit)))

    if query.duration is not None:
        bound(operator.ge, _since(trades, query, as_of))
    if span is not None:
        bound(operator.ge, same_clock(trades, "event_time", span.start))
        bound(operator.lt, same_clock(trades, "event_time", span.end))
    for name in ("ticker", "trade_type", "market_code"):
        value = getattr(query, name)
        if value is not None:
            tests.append(F.col(name) == F.lit(value))
    return trades.where(functools.reduce(operator.and_, tests)) if tests else trades


def newest(
    trades: DataFrame,
    limit: int,
    lanes: int | None = None,
    by_day: bool = False,
    days: list[tuple[date, int]] | None = None,
) -> DataFrame:
    """The ``limit`` newest rows, ties by id; rows without a time come last.

    Each task keeps its own ``limit`` rows, ``lanes`` parallel parts merge them (as
    many as there are shuffle partitions if not given), and one task merges those.
    ``by_day`` first counts the rows of each day of the stored table, so that only
    the newest days are read in full. The plan does not depend on the table's size.
    ``days`` gives those counts, newest first, where they are known without reading rows
    (``sources.day_counts`` takes them from file footers); they must count every row of
    ``trades`` per day, so they suit a stored table with no filter beyond its days.
    """
    order = [F.desc("event_time"), F.desc("event_id")]
    if days is not None:
        trades = _from_day(trades, days, limit)
    elif by_day:
        trades = _newest_days(trades, limit)
    lanes = lanes or int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if lanes > 1:
        lane = Window.partitionBy("_lane").orderBy(*order)
        trades = (
            trades.withColumn("_lane", F.spark_partition_id() % lanes)
            .withColumn("_place", F.row_number().over(lane))
            .where(F.col("_place") <= limit)
            .drop("_lane", "_place")
        )
    return trades.orderBy(*order).limit(limit)


def _newest_days(trades: DataFrame, limit: int) -> DataFrame:
    """Only the newest days that together hold ``limit`` rows.

    Counting reads no more than the filter columns, and yields one row per day. Rows
    without a day are the oldest, so where they are needed nothing is left out.
    """
    days = trades.groupBy("event_date").agg(F.count(F.lit(1)).alias("rows"))
    counted = [(r["event_date"], r["rows"]) for r in days.orderBy(F.desc("event_date")).collect()]
    return _from_day(trades, counted, limit)


def _from_day(trades: DataFrame, days: list[tuple[date | None, int]], limit: int) -> DataFrame:
    """The rows of the newest days whose counts, newest first, reach ``limit``."""
    held = 0
    for day, rows in days:
        held += rows
        if held >= limit and day is not None:
            return trades.where(F.col("event_date") >= F.lit(day))
    return trades


def history(
    trades: DataFrame,
    query: HistoryQuery = HistoryQuery(),
    as_of: datetime | None = None,
    span: TimeRange | None = None,
    limit: int = HISTORY_LIMIT,
) -> DataFrame:
    """Newest matching trades, the answer to a history request."""
    return newest(matching(trades, query, as_of, span), limit)


def history_page(
    trades: DataFrame,
    query: HistoryQuery = HistoryQuery(),
    cursor: Cursor | None = None,
    size: int = 100,
    as_of: datetime | None = None,
    span: TimeRange | None = None,
) -> DataFrame:
    """The ``size`` newest matching trades after ``cursor``.

    A position is compared, not an offset, so late pages cost no more than early
    ones, and on the stored table days newer than the cursor are not read.
    """
    rows = matching(trades, query, as_of, span)
    if cursor is not None:
        at = same_clock(trades, "event_time", cursor.event_time)
        time, row_id = F.col("event_time"), F.col("event_id")
        rows = rows.where((time <= at) & ((time < at) | (row_id < F.lit(cursor.event_id))))
        if "event_date" in trades.columns:
            rows = rows.where(F.col("event_date") <= F.to_date(at))
    return newest(rows, size)


def next_cursor(page: DataFrame, size: int = 100) -> Cursor | None:
    """Where the next page starts, or None after the last one."""
    last = page.agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct("event_time", "event_id")).alias("last")
    ).select(
        "rows",
        iso_text(page, "event_time", F.col("last.event_time")).alias("time"),
        F.col("last.event_id").alias("event_id"),
    )
    row = last.first()
    if row["rows"] < size:
        return None
    return Cursor(datetime.fromisoformat(row["time"]), row["event_id"])


def summary(
    trades: DataFrame,
    query: HistoryQuery = HistoryQuery(),
    as_of: datetime | None = None,
    span: TimeRange | None = None,
    limit: int = HISTORY_LIMIT,
) -> DataFrame:
    """One row: size of the page, size of the whole match, and the filters used.

    The page size follows from the match size, so nothing is sorted.
    """
    found = matching(trades, query, as_of, span).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.sum("volume").alias("total_volume"),
    )
    filters = F.struct(
        F.lit(query.duration).cast("int").alias("duration"),
        F.lit(query.ticker).cast("string").alias("ticker"),
        F.lit(query.trade_type).cast("string").alias("trade_type"),
        F.lit(query.market_code).cast("string").alias("market_code"),
    )
    return found.select(
        F.least("total_count", F.lit(limit).cast("long")).alias("count"),
        "*",
        filters.alias("filters"),
    )


def preview(trades: DataFrame, n: int = 10) -> DataFrame:
    """Any ``n`` rows, in no order."""
    return trades.limit(n)
