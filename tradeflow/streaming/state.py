"""Per-batch folders on shared storage, and running a stream into one.

A micro-batch writes a whole folder ``batch_id=N`` and reads only the one before
it. Running it again, after a lost executor or a restart, replaces the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_path(path, batch_id))


def read_batch(spark: SparkSession, schema: StructType, path: str, batch_id: int) -> DataFrame:
    return spark.read.schema(schema).parquet(batch_path(path, batch_id))


def read_all(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """The rows of every batch, with ``batch_id``."""
    whole = StructType([*schema.fields, StructField("batch_id", LongType())])
    return spark.read.schema(whole).parquet(path)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def finished_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are completely written, oldest first."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    done = []
    for status in files.listStatus(place):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("batch_id=") and files.exists(marker):
            done.append(int(name.removeprefix("batch_id=")))
    return sorted(done)


def forget_before(spark: SparkSession, path: str, batch_id: int) -> None:
    """Drop state of batches older than ``batch_id``, which no replay can need."""
    files, _ = _folder(spark, path)
    for old in finished_batches(spark, path):
        if old < batch_id:
            files.delete(_folder(spark, batch_path(path, old))[1], True)


def start(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Write a stream to a parquet table; without ``every``, only what is there now."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
    )
    return triggered(writer, every).start()


def start_batches(
    stream: DataFrame, step, checkpoint: str, every: str | None = None, mode: str = "append"
) -> StreamingQuery:
    """Call ``step(batch, batch_id)`` for each micro-batch."""
    writer = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
    )
    return triggered(writer, every).start()


def triggered(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def finish(query: StreamingQuery) -> StreamingQuery:
    """Wait for a query over the present data to end. Its failure is raised here."""
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark, in the progress reports still kept."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for report in query.recentProgress
        for operator in report["stateOperators"]
    )


def newest_time(df: DataFrame, column: str) -> int | None:
    """Latest value of a timestamp column in microseconds."""
    return df.agg(F.max(F.unix_micros(column)).alias("t")).first()["t"]
