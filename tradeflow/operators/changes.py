"""Current rows from a change feed, which may repeat and reorder its messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import TRADE_COLUMNS


def _age() -> Column:
    """A total order of changes to one row: time, position in the feed, c < u < d, content."""
    rank = F.when(F.col("op") == "d", 2).when(F.col("op") == "u", 1).otherwise(0)
    return F.struct("ts_ms", F.coalesce("position", F.lit(-1).cast("long")), rank, F.xxhash64("after"))


def newest_changes(changes: DataFrame) -> DataFrame:
    """The last change of every row, deletions included.

    Copies collapse before the shuffle, so a row with very many changes is no
    hot spot. The result has the input's shape and can be merged again.
    """
    change = F.struct("position", "op", "ts_ms", "after")
    return (
        changes.groupBy("event_id")
        .agg(F.max_by(change, _age()).alias("change"))
        .select("event_id", "change.*")
    )


def visible_rows(newest: DataFrame) -> DataFrame:
    """The rows that still exist, as trades."""
    return newest.where(F.col("op") != "d").select(*[F.col(f"after.{c}") for c in TRADE_COLUMNS])


def apply_changes(changes: DataFrame) -> DataFrame:
    """Current trades after all changes, whatever the order they arrived in."""
    return visible_rows(newest_changes(changes))


def merge_changes(settled: DataFrame, fresh: DataFrame) -> DataFrame:
    """Newest change per row from a large settled state and some fresh changes.

    ``settled`` has one change per row. It is read once and grouped by id together
    with the fresh changes; copies collapse before the shuffle.
    """
    columns = ["event_id", "position", "op", "ts_ms", "after"]
    both = settled.select(*columns).unionByName(fresh.select(*columns))
    return newest_changes(both).select(*columns)


def as_changes(trades: DataFrame) -> DataFrame:
    """Existing trades as the oldest changes: a feed without snapshot lacks them."""
    row = {
        "event_time": F.col("event_time").cast("timestamp"),
        "event_id": F.col("event_id").cast("string"),
        "price": F.col("price").cast("double"),
        "volume": F.col("volume").cast("long"),
    }
    after = F.struct(*[row.get(name, F.col(name)).alias(name) for name in TRADE_COLUMNS])
    return trades.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.lit(None).cast("long").alias("position"),
        F.lit("r").alias("op"),
        F.lit(0).cast("long").alias("ts_ms"),
        after.alias("after"),
    )


def bootstrap(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Current trades from a table with unique ids and the changes after it."""
    return visible_rows(merge_changes(as_changes(table), changes))


def without_copies(trades: DataFrame) -> DataFrame:
    """One row per event id. Of rows that differ, the newest is kept."""
    names = trades.columns
    row = F.struct("event_time", *[name for name in names if name != "event_time"])
    return trades.groupBy("event_id").agg(F.max(row).alias("row")).select(
        *[F.col(f"row.{name}") for name in names]
    )
