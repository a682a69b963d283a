"""Fixed schemas of the trade table, its change feed and the derived records."""

from pyspark.sql import types as T

TRADE_COLUMNS = [
    "event_time",
    "event_id",
    "ticker",
    "price",
    "volume",
    "trade_type",
    "trade_id",
    "market_code",
    "currency_code",
]


def _trade(price: T.DataType) -> T.StructType:
    kinds = {"event_time": T.TimestampType(), "price": price, "volume": T.LongType()}
    return T.StructType(
        [T.StructField(name, kinds.get(name, T.StringType())) for name in TRADE_COLUMNS]
    )


# As received: the price bound is checked before the price is rounded.
TRADE_RAW = _trade(T.DoubleType())
# As stored, after the quality gate and normalisation.
TRADE = _trade(T.DecimalType(10, 2))

# The row images inside a change event. Price and time are read as text, because
# a producer may send either a JSON number or a quoted value.
CHANGE_ROW = T.StructType([T.StructField(name, T.StringType()) for name in TRADE_COLUMNS])
ENVELOPE = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("before", CHANGE_ROW),
        T.StructField("after", CHANGE_ROW),
        T.StructField("ts_ms", T.LongType()),
        # Where the producer's log has the change; it orders changes of one moment.
        T.StructField("source", T.StructType([T.StructField("lsn", T.LongType())])),
    ]
)

SUBSCRIPTION = T.StructType(
    [
        T.StructField("sub_id", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("tick", T.IntegerType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

TICK_MESSAGE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType())]
            ),
        ),
        T.StructField("current_tick", T.IntegerType()),
    ]
)

ANOMALY = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("evidence", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
