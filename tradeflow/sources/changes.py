"""Change feed of the trade table: JSON row events from Kafka or from files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary_decimal
from ..schema import ENVELOPE, TRADE_COLUMNS


def read_changes(
    spark: SparkSession,
    *,
    path: str | None = None,
    servers: str | None = None,
    topic: str | None = None,
    **options: str,
) -> DataFrame:
    """Stream of raw change events in ``value``, with ``position`` where known.

    From Kafka, the offset orders the changes of one key; text files have none. A log
    position in the message (``source.lsn``) takes its place.
    """
    if (path is None) == (topic is None):
        raise ValueError("give either a path of JSON lines or a Kafka topic")
    reader = spark.readStream.options(**options)
    if path is not None:
        lines = reader.format("text").load(path)
        return lines.select("value", F.lit(None).cast("long").alias("position"))
    stream = (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    return stream.select(
        F.col("value").cast("string").alias("value"), F.col("offset").alias("position")
    )


# Fields of a row image that are not text. A value that is there but cannot be read,
# such as a decimal in binary form, must not become null and pass.
TYPED = ("event_time", "price", "volume")


def _moment(text: Column) -> Column:
    """ISO text, or microseconds since the epoch, as a timestamp."""
    micros = F.when(text.rlike(r"\A-?[0-9]+\z"), text.try_cast("long"))
    return F.coalesce(F.timestamp_micros(micros), text.try_cast("timestamp"))


def _image(row: str, binary: Mapping[str, int]) -> Column:
    """A row image with the types of a raw trade, null when the image is null."""
    kinds = {"price": "double", "volume": "long"}
    fields = []
    for name in TRADE_COLUMNS:
        field = F.col(f"{row}.{name}")
        if name == "event_time":
            field = _moment(field)
        elif name in binary:
            field = binary_decimal(field, binary[name]).cast(kinds.get(name, "string"))
        elif name in kinds:
            field = field.try_cast(kinds[name])
        fields.append(field.alias(name))
    return F.when(F.col(row).isNotNull(), F.struct(*fields))


def parse_changes(raw: DataFrame, binary_decimals: Mapping[str, int] | None = None) -> DataFrame:
    """Typed changes, plus ``problem``: null for a usable one, else the reason.

    ``event_id`` is the identity of the changed row. Works on batches and streams.
    ``binary_decimals`` names the fields that come as base64 bytes of an unscaled
    number, with their scale: a connector without a decimal mode sends NUMERIC columns
    so. Such a field that is not base64 or does not fit is ``unreadable``, not null.
    """
    binary = dict(binary_decimals or {})
    if "position" not in raw.columns:
        raw = raw.withColumn("position", F.lit(None).cast("long"))
    # A generator, because a filter on parsed fields would otherwise be pushed
    # below and parse the text again for each of them.
    opened = raw.select("value", "position", F.inline(F.array(F.from_json("value", ENVELOPE))))
    typed = opened.select(
        "value",
        F.coalesce("source.lsn", "position").alias("position"),
        F.struct(*[F.col(f"after.{name}").alias(name) for name in TYPED]).alias("sent"),
        "op",
        "ts_ms",
        _image("before", binary).alias("before"),
        _image("after", binary).alias("after"),
    )
    key = F.coalesce(F.col("after.event_id"), F.col("before.event_id"))
    op = F.coalesce(F.col("op"), F.lit(""))
    problem = (
        F.when(F.col("value").isNull(), "null value")
        .when(~op.isin("c", "u", "d", "r"), "no such operation")
        .when(F.col("ts_ms").isNull(), "no time of change")
        .when(key.isNull(), "no event id")
        .when((op != "d") & F.col("after").isNull(), "no new row")
    )
    for name in TYPED:
        lost = F.col(f"sent.{name}").isNotNull() & F.col(f"after.{name}").isNull()
        problem = problem.when((op != "d") & lost, f"unreadable {name}")
    return typed.select("*", key.alias("event_id"), problem.alias("problem")).drop("sent")


def split_changes(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable changes and rejected messages."""
    usable = parsed.where(F.col("problem").isNull()).drop("value", "problem")
    rejected = parsed.where(F.col("problem").isNotNull()).select("value", "position", "problem")
    return usable, rejected
