"""Streams of text messages to Kafka or to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .state import triggered


def start_messages(
    messages: DataFrame,
    checkpoint: str,
    *,
    path: str | None = None,
    servers: str | None = None,
    topic: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Send ``value`` of each message; in Kafka the ticker is the key."""
    if (path is None) == (topic is None):
        raise ValueError("give either a folder or a Kafka topic")
    if path is not None:
        writer = messages.select("value").writeStream.format("text").option("path", path)
    else:
        keyed = messages.select(F.col("ticker").alias("key"), "value")
        writer = (
            keyed.writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("topic", topic)
        )
    return triggered(writer.option("checkpointLocation", checkpoint), every).start()
