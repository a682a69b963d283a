"""The given tables in the shape of trades, changes, requests and subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key_of_props() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def events_as_trades(events: DataFrame, zoned: bool = False) -> DataFrame:
    """Event rows as trades. Streams need ``zoned`` timestamps for a watermark."""
    time = F.col("ts").cast("timestamp") if zoned else F.col("ts")
    return events.select(
        time.alias("event_time"),
        F.col("event_id"),
        F.upper("event_type").alias("ticker"),
        F.col("value").alias("price"),
        (_key_of_props() + 1).alias("volume"),
        F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL").alias("trade_type"),
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("trade_id"),
        F.when(F.col("user_id") % 3 == 0, "NASDAQ")
        .when(F.col("user_id") % 3 == 1, "NYSE")
        .otherwise("AMEX")
        .alias("market_code"),
        F.lit("USD").alias("currency_code"),
    )


def lineitem_as_trades(lineitem: DataFrame) -> DataFrame:
    """Order lines as trades. They have no unique id, so equal lines share one."""
    return lineitem.select(
        F.col("l_shipdate").alias("event_time"),
        F.xxhash64(*sorted(lineitem.columns)).cast("string").alias("event_id"),
        F.concat(F.lit("P"), (F.col("l_partkey") % 25).cast("string")).alias("ticker"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").cast("long").alias("volume"),
        F.when(F.col("l_linestatus") == "F", "BUY").otherwise("SELL").alias("trade_type"),
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("trade_id"),
        F.col("l_returnflag").alias("market_code"),
        F.lit("USD").alias("currency_code"),
    )


def _unscaled_base64(price: Column, scale: int, wide: Column) -> Column:
    """Base64 of the big-endian two's complement bytes of ``price * 10**scale``: 8 bytes,
    or 16 sign-extended ones where ``wide``."""
    number = (price * 10**scale).cast("long")
    eight = F.lpad(F.hex(number), 16, "0")
    sixteen = F.lpad(eight, 32, F.when(number < 0, "F").otherwise("0"))
    return F.base64(F.unhex(F.when(wide, sixteen).otherwise(eight)))


def orders_as_change_feed(orders: DataFrame, binary_scale: int | None = None) -> DataFrame:
    """Orders as JSON change events in a ``value`` column.

    Every order is created; a third is updated, a fifth deleted, and of the
    updates every second one repeats, as a connector may deliver twice. With
    ``binary_scale``, prices go as base64 bytes of the unscaled number, as a connector
    sends NUMERIC columns by default; orders whose key is divisible by 7 are then
    refunds with a negative price, and even keys take 16 bytes instead of 8.
    """

    def image(price: Column) -> Column:
        if binary_scale is not None:
            signed = F.when(F.col("o_orderkey") % 7 == 0, -price).otherwise(price)
            price = _unscaled_base64(signed, binary_scale, F.col("o_orderkey") % 2 == 0)
        return F.struct(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_time"),
            F.col("o_orderkey").cast("string").alias("event_id"),
            F.concat(F.lit("O"), F.col("o_orderstatus")).alias("ticker"),
            price.alias("price"),
            (F.col("o_custkey") + 1).alias("volume"),
            F.when(F.col("o_custkey") % 2 == 0, "BUY").otherwise("SELL").alias("trade_type"),
            F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("trade_id"),
            F.lit("NYSE").alias("market_code"),
            F.lit("USD").alias("currency_code"),
        )

    key, op = F.col("o_orderkey"), F.col("op")
    ops = F.array_compact(
        F.array(
            F.lit("c"),
            F.when(key % 3 == 0, "u"),
            F.when(key % 6 == 0, "u"),
            F.when(key % 5 == 0, "d"),
        )
    )
    price = F.col("o_totalprice").cast("decimal(12,2)")
    first, second = image(price), image((price + 1).cast("decimal(12,2)"))
    event = F.struct(
        op.alias("op"),
        F.when(op == "u", first).when(op == "d", second).alias("before"),
        F.when(op == "c", first).when(op == "u", second).alias("after"),
        (key * 10 + F.when(op == "c", 1).when(op == "u", 2).otherwise(3)).alias("ts_ms"),
    )
    return orders.select("*", F.explode(ops).alias("op")).select(F.to_json(event).alias("value"))


def orders_as_requests(orders: DataFrame) -> DataFrame:
    """Orders as history requests, valid and invalid ones mixed."""
    key = F.col("o_orderkey")
    return orders.select(
        key.alias("request_id"),
        F.when(key % 7 != 0, F.col("o_custkey") % 50).alias("duration"),
        F.when(key % 4 == 0, F.lower("o_orderstatus"))
        .when(key % 4 == 1, F.col("o_orderpriority"))
        .when(key % 4 == 2, F.col("o_orderstatus"))
        .alias("ticker"),
        F.when(key % 3 == 0, "buy").when(key % 3 == 1, "Sell").otherwise("HOLD").alias("tradeType"),
        F.when(key % 2 == 0, "NYSE").alias("marketCode"),
    )


def customers_as_subscriptions(customer: DataFrame) -> DataFrame:
    """Two requests per customer; the later one must win. One ticker is unknown."""
    tickers = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW", "NOSUCH"]
    key = F.col("c_custkey")

    def pick(shift: int) -> Column:
        names = F.array(*[F.lit(name) for name in tickers])
        return F.get(names, ((key + shift) % len(tickers)).cast("int"))

    def request(shift: int, tick: Column, at: str) -> Column:
        return F.struct(
            pick(shift).alias("ticker"),
            tick.cast("int").alias("tick"),
            F.lit(at).cast("timestamp").alias("updated_at"),
        )

    old = request(1, F.lit(5), "2023-12-01 00:00:00+00:00")
    new = request(0, key % 62, "2023-12-02 00:00:00+00:00")
    return customer.select(
        F.concat(F.lit("S"), key.cast("string")).alias("sub_id"),
        F.explode(F.array(new, old)).alias("request"),
    ).select("sub_id", "request.*")
