"""Window columns over the preceding rows of a key, also when one key is huge.

``Window.partitionBy(key)`` puts a whole key into one task. Here a key with too
many rows is cut into runs of consecutive rows of about equal size; each run
receives copies of the few rows before it, so that every frame is complete.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import work_dir

ROWS_PER_TASK = 2_000_000
MAX_RUNS = 50_000
_SAMPLES_PER_RUN = 20


def over_preceding(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    reach: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    rows_per_task: int = ROWS_PER_TASK,
    at_most: int | None = None,
) -> DataFrame:
    """Add ``columns(window)``, which may look back at most ``reach`` rows of the key.

    ``df`` is read several times when a key is huge: pass a pruned scan. Rows
    that agree in all of ``order`` should be copies of each other. ``at_most`` is
    a number of rows that no key exceeds, where the caller knows one.
    """
    if at_most is not None and at_most <= rows_per_task:
        return df.withColumns(columns(Window.partitionBy(key).orderBy(*order)))
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    size = counts.agg(F.max("rows").alias("largest"), F.sum("rows").alias("total")).first()
    if (size["largest"] or 0) <= rows_per_task:
        added = columns(Window.partitionBy(key).orderBy(*order))
        return df.withColumns(added)

    run_rows = max(rows_per_task, math.ceil(size["total"] / MAX_RUNS))
    cuts = _cuts(df, counts, key, order, reach, run_rows)
    # About two points per run of run_rows rows, so about 2 * MAX_RUNS of them in all.
    # Should a sample give more than expected, the last runs are only longer.
    expected = 4 * math.ceil(size["total"] / run_rows) + 32
    placed = _with_points_upto(_beside(df, cuts, key, "left"), order, expected)
    placed = placed.withColumn("_run", F.shiftright("_at", 1))
    carried = _rows_before_cuts(placed, cuts, key, order, reach)
    if carried is None:
        carried = _rows_before_runs(placed, key, order, reach)
    everything = (
        placed.drop("_cuts", "_at")
        .withColumn("_carried", F.lit(False))
        .unionByName(carried.withColumn("_carried", F.lit(True)))
    )
    added = columns(Window.partitionBy(key, "_run").orderBy(*order))
    return everything.withColumns(added).where(~F.col("_carried")).drop("_carried", "_run")


def _beside(df: DataFrame, few: DataFrame, key: str, how: str) -> DataFrame:
    """Join with the few rows of huge keys; null is a key like any other."""
    known = F.broadcast(few.withColumnRenamed(key, "_key"))
    return df.join(known, F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")


def _cuts(
    df: DataFrame, counts: DataFrame, key: str, order: Sequence[str], reach: int, run_rows: int
) -> DataFrame:
    """Per huge key, a sorted array of row keys: marker, cut, marker, cut, and so on.

    A run ends at a cut; its marker is a little before, so that the last rows of
    the run can be found between the two. A sample only decides where to cut,
    not what is computed. It is written down, since every later job must cut at
    the same points.
    """
    spark = df.sparkSession
    huge = counts.where(F.col("rows") > run_rows).select(key)
    share = min(1.0, _SAMPLES_PER_RUN / run_rows)
    sample = _beside(df.select(key, *order).sample(share, seed=11), huge, key, "inner")
    step = max(2, round(run_rows * share))
    ahead = min(step - 1, math.ceil(4 * reach * share) + 2)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    sorted_points = F.array_sort(F.collect_list(F.struct(*order)))
    points = (
        sample.withColumn("_rank", rank)
        .where((F.col("_rank") % step).isin(0, step - ahead))
        .groupBy(key)
        .agg(sorted_points.alias("_cuts"))
        # A marker at the end has no cut.
        .withColumn("_cuts", F.slice("_cuts", 1, F.size("_cuts") - F.size("_cuts") % 2))
    )
    path = work_dir(spark, "cuts")
    points.write.parquet(path)
    return spark.read.schema(points.schema).parquet(path)


def _with_points_upto(df: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """Add ``_at``, how many points are at or before the row; zero without points.

    A binary search with one projection per step. They run in one compiled loop;
    a fold over the array would be interpreted, at about twice the time. The
    generator at the end keeps filters on ``_at`` above it: pushed down, they
    would repeat the nested steps in every place.
    """
    df = df.withColumn("_row", F.struct(*order)).withColumn("_at", F.lit(0))
    for bit in reversed(range(most.bit_length())):
        step = 1 << bit
        passed = F.get("_cuts", F.col("_at") + (step - 1)) <= F.col("_row")
        df = df.withColumn("_at", F.col("_at") + F.when(passed, step).otherwise(0))
    names = [name for name in df.columns if name not in ("_row", "_at")]
    return df.select(*names, F.explode(F.array("_at")).alias("_at"))


def _carry_columns(placed: DataFrame) -> list[str]:
    return [name for name in placed.columns if name not in ("_cuts", "_at")]


def _rows_before_cuts(
    placed: DataFrame, cuts: DataFrame, key: str, order: Sequence[str], reach: int
) -> DataFrame | None:
    """For every run, copies of the ``reach`` rows before it, from behind the markers.

    Only the few rows behind a marker are sorted. None if some marker turns out
    to have fewer than ``reach`` rows behind it.
    """
    spark = placed.sparkSession
    newest_first = Window.partitionBy(key, "_at").orderBy(*[F.desc(name) for name in order])
    near = (
        placed.where(F.col("_at") % 2 == 1)
        .withColumn("_back", F.row_number().over(newest_first))
        .where(F.col("_back") <= reach)
        .withColumn("_run", F.col("_run") + 1)
        .select(*_carry_columns(placed))
    )
    path = work_dir(spark, "carried")
    near.write.parquet(path)
    carried = spark.read.schema(near.schema).parquet(path)
    wanted = cuts.agg(F.sum(F.size("_cuts")).alias("points")).first()["points"] or 0
    return carried if carried.count() == wanted // 2 * reach else None


def _rows_before_runs(placed: DataFrame, key: str, order: Sequence[str], reach: int) -> DataFrame:
    """The same from all rows of the split keys, however short their runs are."""
    names = _carry_columns(placed)
    rest = [name for name in names if name not in (key, "_run", *order)]
    newest_first = Window.partitionBy(key, "_run").orderBy(*[F.desc(name) for name in order])
    tails = (
        placed.where(F.col("_cuts").isNotNull())
        .withColumn("_back", F.row_number().over(newest_first))
        .where(F.col("_back") <= reach)
        .groupBy(key, "_run")
        .agg(F.collect_list(F.struct(*order, *rest)).alias("_tail"))
    )
    # One row per run, each with at most ``reach`` entries. A run may be short,
    # so look back over as many runs as could be needed.
    earlier = Window.partitionBy(key).orderBy("_run").rowsBetween(-reach, -1)
    near = F.flatten(F.collect_list("_tail").over(earlier))
    nearest = F.slice(F.sort_array(near, asc=False), 1, reach)
    before = tails.select(key, "_run", nearest.alias("_before"))
    return before.selectExpr(key, "_run", "inline(_before)").select(*names)
