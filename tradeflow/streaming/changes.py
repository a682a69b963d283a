"""The current trades, kept up to date from a change stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import merge_changes, newest_changes, visible_rows
from ..schema import TRADE_RAW
from ..sources.changes import parse_changes, split_changes
from . import state

CHANGE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("after", TRADE_RAW),
    ]
)
REJECT = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("problem", T.StringType()),
    ]
)


def start_changes(
    raw: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Log the newest change per row of each batch, and the unusable messages.

    The table is not rewritten per batch: the log is merged when it is read.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        usable, rejected = split_changes(parse_changes(batch))
        columns = [field.name for field in CHANGE.fields]
        state.write_batch(newest_changes(usable).select(*columns), f"{path}/log", batch_id)
        state.write_batch(rejected, f"{path}/rejected", batch_id)

    return state.start_batches(raw, step, checkpoint, every)


def _merged(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Newest change per row from the last snapshot and the log after it."""
    snapshots = state.finished_batches(spark, f"{path}/snapshot")
    logged = state.finished_batches(spark, f"{path}/log")
    covered, upto = max(snapshots, default=-1), max(logged, default=-1)
    if upto <= covered:
        log = spark.createDataFrame([], CHANGE)
    else:
        batch = F.col("batch_id")
        log = state.read_all(spark, CHANGE, f"{path}/log")
        log = log.where((batch > covered) & (batch <= upto)).drop("batch_id")
    if not snapshots:
        return newest_changes(log), upto
    snapshot = state.read_batch(spark, CHANGE, f"{path}/snapshot", covered)
    return merge_changes(snapshot, log), max(covered, upto)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The trades that exist after all logged changes."""
    return visible_rows(_merged(spark, path)[0])


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    return state.read_all(spark, REJECT, f"{path}/rejected")


def compact(spark: SparkSession, path: str) -> None:
    """Fold the log into a snapshot, to be run as a job of its own from time to time.

    Deletions stay in it, so an older change that arrives late cannot bring a
    deleted row back.
    """
    merged, upto = _merged(spark, path)
    if upto >= 0 and upto not in state.finished_batches(spark, f"{path}/snapshot"):
        columns = [field.name for field in CHANGE.fields]
        state.write_batch(merged.select(*columns), f"{path}/snapshot", upto)
