"""Each trade once, however late its copy comes: fresh ids against the stored ids of their days.

A watermark forgets an id once it is older than the delay; a copy sent later passes, and
an original sent later is dropped as late. Here every micro-batch is judged against the
trades already written, so neither happens:

1. copies within the batch collapse (``dropDuplicates`` on the id, partial per task);
2. the batch's days are listed (one row per day, bounded by the span of a batch);
3. the stored ids of those days only, in folders of earlier batches, are semi-joined with
   the batch's ids: the day folders of all other days are pruned, and the batch's own
   folder is skipped, so a retried batch judges the same rows again;
4. the rest are written to the batch's folder, by day, replacing what a failed try left.

A copy of a trade has the trade's time, so it lands in the same day as the original.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from . import state


def _stored(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    whole = T.StructType(
        [*schema.fields, T.StructField("event_date", T.DateType()), T.StructField("batch_id", T.LongType())]
    )
    return spark.read.schema(whole).parquet(path)


def new_trades(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """The trades of ``batch`` whose id no earlier batch has written to ``path``."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(["event_id"]).withColumn("event_date", F.to_date("event_time"))
    days = [r["event_date"] for r in fresh.select("event_date").distinct().collect()]
    if not state.finished_batches(spark, path) or not days:
        return fresh
    day = F.col("event_date")
    same_days = day.isin([d for d in days if d is not None])
    if None in days:  # trades without a time are kept in a folder of their own
        same_days = same_days | day.isNull()
    stored = _stored(spark, batch.schema, path).where((F.col("batch_id") < batch_id) & same_days)
    seen = stored.select("event_id").join(fresh.select("event_id"), "event_id", "left_semi")
    return fresh.join(seen, "event_id", "left_anti")


def start_stored_dedup(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write each trade of the stream once to ``path``, in folders per batch and day."""

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = new_trades(batch, path, batch_id)
        kept.write.mode("overwrite").partitionBy("event_date").parquet(state.batch_path(path, batch_id))

    return state.start_batches(stream, step, checkpoint, every)


def read_stored(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """The trades written, without the folder columns."""
    return _stored(spark, schema, path).drop("event_date", "batch_id")
