"""Row rules: which trades, requests and subscriptions are acceptable, and why not."""

from __future__ import annotations

import functools
import operator
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round_price

# Fixed values of the trade, request and subscription rules.
MAX_PRICE = 10000
MAX_VOLUME = 1000000
MAX_TICKER = 10
MAX_MARKET_CODE = 20
CURRENCY_LENGTH = 3
MAX_TICK_SECONDS = 60
TRADE_TYPES = ("BUY", "SELL")
LONGEST_RANGE = timedelta(days=30)

_UUID = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
_CAPITALS = r"\A[A-Z]+\z"


def _length(name: str, low: int, high: int) -> Column:
    return F.char_length(name).between(low, high)


def trade_rules(uuids: bool = True) -> dict[str, Column]:
    """What must hold for each column of a raw trade. Bounds apply before rounding."""

    def identity(name: str) -> Column:
        column = F.col(name)
        return column.rlike(_UUID) if uuids else column.isNotNull()

    price, volume = F.col("price"), F.col("volume")
    return {
        "event_time": F.col("event_time").isNotNull(),
        "event_id": identity("event_id"),
        "ticker": _length("ticker", 1, MAX_TICKER),
        "price": (price > 0) & (price <= MAX_PRICE),
        "volume": (volume > 0) & (volume <= MAX_VOLUME),
        "trade_type": F.col("trade_type").isin(*TRADE_TYPES),
        "trade_id": identity("trade_id"),
        "market_code": _length("market_code", 1, MAX_MARKET_CODE),
        "currency_code": _length("currency_code", CURRENCY_LENGTH, CURRENCY_LENGTH),
    }


def request_rules() -> dict[str, Column]:
    """Rules of a history request; every parameter may be missing."""

    def optional(name: str, rule: Column) -> Column:
        return F.col(name).isNull() | rule

    return {
        "duration": optional("duration", F.col("duration") >= 1),
        "ticker": optional("ticker", F.col("ticker").rlike(_CAPITALS)),
        "trade_type": optional("trade_type", F.col("trade_type").isin(*TRADE_TYPES)),
        "market_code": optional("market_code", F.col("market_code").rlike(_CAPITALS)),
    }


def subscription_rules() -> dict[str, Column]:
    """Rules of a tick request. The case of the ticker does not matter."""
    return {
        "ticker": _length("ticker", 1, MAX_TICKER),
        "tick": F.col("tick").between(1, MAX_TICK_SECONDS),
    }


def range_rules(longest: timedelta = LONGEST_RANGE) -> dict[str, Column]:
    """Rules of a half-open span of time, as for ``history.TimeRange``."""
    start, end = F.unix_micros("start"), F.unix_micros("end")
    return {
        "end": end > start,
        "length": end - start <= longest // timedelta(microseconds=1),
    }


def _all_hold(rules: dict[str, Column]) -> Column:
    return functools.reduce(operator.and_, rules.values())


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``, the names of the rules that do not hold. Null breaks a rule.

    Rows without any, as most should be, do not go through the list of names.
    """
    broken = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]
    none = F.array().cast("array<string>")
    named = F.when(_all_hold(rules), none).otherwise(F.array_compact(F.array(*broken)))
    return df.withColumn("violations", named)


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with their violations.

    The first is a plain filter, whose bounds reach the scan.
    """
    kept = _all_hold(rules)
    return df.where(kept), check(df.where(~F.coalesce(kept, F.lit(False))), rules)


def validate_trades(raw: DataFrame, uuids: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected trades: one bad row does not fail its batch."""
    return split(raw, trade_rules(uuids))


def normalize_trades(trades: DataFrame) -> DataFrame:
    """Upper-case codes and whole cents. Run it after the gate, not before."""
    return trades.withColumns(
        {
            "ticker": F.upper("ticker"),
            "currency_code": F.upper("currency_code"),
            "price": round_price(F.col("price")),
        }
    )


def check_requests(requests: DataFrame, keep: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """A table of history requests with camelCase parameters, renamed and checked."""
    names = {
        "duration": "duration",
        "ticker": "ticker",
        "tradeType": "trade_type",
        "marketCode": "market_code",
    }
    unknown = set(requests.columns) - set(names) - set(keep)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    renamed = requests.withColumnsRenamed(names)
    return check(renamed.withColumn("trade_type", F.upper("trade_type")), request_rules())


def check_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """All tick requests, the first ones and the updates, with their violations."""
    return check(subscriptions, subscription_rules())


def check_ranges(ranges: DataFrame, longest: timedelta = LONGEST_RANGE) -> DataFrame:
    """A table of spans from ``start`` to ``end``, timestamps, with their violations."""
    return check(ranges, range_rules(longest))


def validate_subscriptions(subscriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected tick requests."""
    return split(subscriptions, subscription_rules())
