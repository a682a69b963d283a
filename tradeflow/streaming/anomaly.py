"""Streaming forms of the rules that need the order of a ticker's trades.

Rows of a micro-batch are unordered and may be late. They wait until the
watermark has passed them; the closed ones are then final and go, together with
the last few rows of each ticker, through the same window operator as a batch.
That operator also splits a ticker too large for one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import anomaly
from ..operators.ordered import ROWS_PER_TASK, over_preceding
from ..schema import ANOMALY
from . import state


@dataclass(frozen=True)
class OrderedRules:
    """Rules over the ``reach`` rows of a ticker before the current one."""

    time: str
    order: tuple[str, ...]
    value: str
    reach: int
    columns: Callable[[WindowSpec], dict[str, Column]]
    rules: Callable[[], list[anomaly.Rule]]


def price_rules(
    length: int = 20, zscore: float | None = 3.0, jump: float | None = 0.5
) -> OrderedRules:
    """The z-score and the jump rule in one stream; None leaves a rule out."""

    def columns(window: WindowSpec) -> dict[str, Column]:
        return {**anomaly.zscore_columns(window, length), **anomaly.jump_columns(window)}

    def rules() -> list[anomaly.Rule]:
        chosen = []
        if zscore is not None:
            chosen.append(anomaly.zscore_rule(length, zscore))
        if jump is not None:
            chosen.append(anomaly.jump_rule(jump))
        return chosen

    return OrderedRules("event_time", anomaly.ORDER, "price", length, columns, rules)


def volume_rules(length: int = 5, times: float = 3.0) -> OrderedRules:
    """For the volumes of closed windows, as ``windows.volume_stream`` gives them."""
    return OrderedRules(
        "bucket_start",
        ("bucket_start",),
        "volume",
        length,
        lambda window: anomaly.spike_columns(window, length),
        lambda: [anomaly.spike_rule(length, times)],
    )


_CLOCK = T.StructType([T.StructField("micros", T.LongType())])


def _micros(delay: str) -> int:
    number, unit = re.fullmatch(r"(\d+) (second|minute|hour|day)s?", delay).groups()
    return timedelta(**{unit + "s": int(number)}) // timedelta(microseconds=1)


def start_rules(
    stream: DataFrame,
    rule: OrderedRules,
    path: str,
    checkpoint: str,
    delay: str | None,
    every: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> StreamingQuery:
    """Write the anomalies of ordered rules, per batch, below ``path``.

    ``delay`` is how far rows may come behind the newest one. None says that the
    rows are final as they come, such as closed windows.
    """
    names = ["ticker", *rule.order, rule.value]
    schema = T.StructType([stream.schema[name] for name in names])
    wait = None if delay is None else _micros(delay)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def before(part: str, kind: T.StructType) -> DataFrame:
            if batch_id == 0:
                return spark.createDataFrame([], kind)
            return state.read_batch(spark, kind, f"{path}/{part}", batch_id - 1)

        # Not a lineage cut: only spares the source a second read.
        fresh = batch.select(*names).persist()
        try:
            time = F.unix_micros(rule.time)
            if wait is None:
                closed = fresh
            else:
                row = before("clock", _CLOCK).first()
                old = row["micros"] if row else None
                newest = state.newest_time(fresh, rule.time)
                marks = [old, None if newest is None else newest - wait]
                mark = max((m for m in marks if m is not None), default=None)
                in_time = fresh if old is None else fresh.where(time >= old)
                late = fresh.where(F.lit(False) if old is None else time < old)
                known = in_time.unionByName(before("pending", schema))
                is_closed = F.lit(False) if mark is None else time < mark
                closed = known.where(is_closed)
                state.write_batch(known.where(~is_closed), f"{path}/pending", batch_id)
                state.write_batch(late, f"{path}/late", batch_id)
                clock = spark.createDataFrame([(mark,)], _CLOCK)
                state.write_batch(clock, f"{path}/clock", batch_id)

            rows = (
                closed.withColumn("_new", F.lit(True))
                .unionByName(before("tail", schema).withColumn("_new", F.lit(False)))
            )
            judged = over_preceding(
                rows, "ticker", rule.order, rule.reach, rule.columns, rows_per_task
            )
            found = anomaly.emit(judged.where("_new"), *rule.rules())
            state.write_batch(found, f"{path}/anomalies", batch_id)
            back = Window.partitionBy("ticker").orderBy(*[F.desc(name) for name in rule.order])
            tail = rows.withColumn("_back", F.row_number().over(back))
            tail = tail.where(F.col("_back") <= rule.reach).select(*names)
            state.write_batch(tail, f"{path}/tail", batch_id)
        finally:
            fresh.unpersist()
        for part in ("tail",) if wait is None else ("tail", "pending", "clock"):
            state.forget_before(spark, f"{path}/{part}", batch_id - 1)

    return state.start_batches(stream, step, checkpoint, every)


def read_anomalies(spark: SparkSession, path: str) -> DataFrame:
    return state.read_all(spark, ANOMALY, f"{path}/anomalies").drop("batch_id")


def count_late(spark: SparkSession, path: str) -> int:
    """Rows that came after their time had been closed, which no rule has seen."""
    return spark.read.parquet(f"{path}/late").count()
