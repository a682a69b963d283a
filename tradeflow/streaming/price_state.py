"""The z-score and jump rules of a trade stream on Spark's own state store.

One stateful processor per ticker (``transformWithStateInPandas``, RocksDB store,
event-time timers) keeps:

- ``chunks``: rows that wait for the watermark. The rows a micro-batch brings are sorted
  by (event_time, event_id) and kept as Arrow chunks of up to ``CHUNK_ROWS`` rows, so that
  a call to the state store moves thousands of rows;
- ``waiting``: the number, span and size of each chunk, and the ticker's one timer, at the
  millisecond of its oldest waiting row;
- ``tail``: the last ``length`` closed rows, which the next ones are judged against.

A row older than the watermark when it comes is late: no rule sees it. Spark drops rows
older than the watermark of the batch before without showing them to the processor (they
count in ``numRowsDroppedByWatermark``); those between that and the present watermark
are written out as late. When the watermark passes the oldest waiting row the timer
fires: chunks are read in the order of their first rows and merged, and the rows behind
the watermark, in (event_time, event_id) order, are judged against the tail a stretch at
a time. A batch thus reads only the chunks that hold rows it closes and the tail, and a
task holds the chunks that overlap in time, however many rows wait.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.anomaly import EVENT_TYPE

#: Rows that are sorted together as they come, and rows of a chunk in the state store.
RUN_ROWS = 1 << 18
CHUNK_ROWS = 1 << 14

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ROW = T.StructType(
    [T.StructField("t", T.LongType()), T.StructField("id", T.StringType()), T.StructField("price", T.DoubleType())]
)
_NUMBER = T.StructType([T.StructField("n", T.LongType())])
_CHUNK = T.StructType([T.StructField("rows", T.BinaryType())])
_WAITING = T.StructType(
    [
        T.StructField("next", T.LongType()),  # number of the next chunk
        T.StructField("timer", T.LongType()),
        T.StructField("spans", T.BinaryType()),  # (number, first micros, rows) of each chunk
    ]
)
OUT = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("micros", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("deviation", T.DoubleType()),
        T.StructField("previous", T.DoubleType()),
    ]
)


_TEXT = {"ticker", "kind", "event_id", "rule"}


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Output rows as a frame whose column types follow OUT, whatever the values look like."""
    columns = {}
    for k, name in enumerate(OUT.names):
        values = [row[k] for row in rows]
        if name in _TEXT:
            columns[name] = pd.Series([None if v is None else str(v) for v in values], dtype=object)
        elif name == "micros":
            columns[name] = pd.Series(values, dtype="int64")
        else:
            columns[name] = pd.Series([None if v is None else float(v) for v in values], dtype="float64")
    return pd.DataFrame(columns)


def judge(tail: list[tuple], rows: list[tuple], length: int, zscore: float | None, jump: float | None):
    """Anomalies of rows (t, id, price) in order after tail, as the batch rules find them.

    Prices are summed as whole cents, so a flat run has a deviation of exactly zero.
    """
    found, before = [], len(tail)
    seen = [*tail, *rows]
    prices = np.array([price for _, _, price in seen], np.float64)
    with np.errstate(all="ignore"):
        changes = np.full(len(seen), np.nan)
        changes[1:] = np.where(prices[:-1] != 0, prices[1:] / prices[:-1] - 1, np.nan)
        scores, means, deviations = _scores(prices, length)
        unusual = np.zeros(len(seen), bool) if zscore is None else np.abs(scores) >= zscore
        jumped = np.zeros(len(seen), bool) if jump is None else np.abs(changes) >= jump
    unusual[:before] = jumped[:before] = False
    for k in np.flatnonzero(unusual | jumped).tolist():
        t, event_id, price = seen[k]
        if unusual[k]:
            numbers = float(scores[k]), price, float(means[k]) / 100, float(deviations[k]) / 100
            found.append(("anomaly", t, event_id, "price_zscore", *numbers, None))
        if jumped[k]:
            found.append(("anomaly", t, event_id, "price_jump", float(changes[k]), price, None, None, seen[k - 1][2]))
    return found, seen[-max(length, 1) :]


def _scores(prices: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each price's z-score among the ``length`` before it, their mean and deviation in cents.

    NaN where there are fewer before it or they do not differ.
    """
    scores, means, deviations = np.full((3, len(prices)), np.nan)
    if len(prices) > length:
        cents = _cents(prices)
        total, squares = (
            np.lib.stride_tricks.sliding_window_view(values[:-1], length).sum(axis=1) for values in (cents, cents * cents)
        )
        spread = squares * length - total * total
        spread[~(spread > 0)] = np.nan
        means[length:] = total / length
        deviations[length:] = np.sqrt(spread / (length * (length - 1)))
        scores[length:] = (cents[length:] - means[length:]) / deviations[length:]
    return scores, means, deviations


def _cents(prices: np.ndarray) -> np.ndarray:
    """Prices as whole cents, halves away from zero."""
    scaled = prices * 100
    whole = np.trunc(scaled)
    return whole + np.sign(scaled) * (np.abs(scaled - whole) >= 0.5)


def _ordered(rows: pa.Table) -> pa.Table:
    order = pc.sort_indices(rows, sort_keys=[("t", "ascending"), ("id", "ascending")], null_placement="at_start")
    return rows.take(order).combine_chunks()


def _rows(rows: pa.Table) -> list[tuple]:
    """(t, id, price) of each row, ids as text."""
    return list(zip(rows["t"].to_pylist(), rows["id"].cast(pa.string()).to_pylist(), rows["price"].to_pylist()))


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(blob))).read_all()


class PriceRules(StatefulProcessor):
    """Per ticker: rows wait in sorted chunks until the watermark passes them.

    ``whole_ids`` says that event ids, which come as text, are whole numbers and are
    ordered as such.
    """

    def __init__(
        self, length: int = 20, zscore: float | None = 3.0, jump: float | None = 0.5, whole_ids: bool = False
    ):
        self.length, self.zscore, self.jump, self.whole_ids = length, zscore, jump, whole_ids

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", _NUMBER, _CHUNK)
        self.waiting = handle.getValueState("waiting", _WAITING)
        self.tail = handle.getListState("tail", _ROW)

    def _read(self) -> tuple[int, int | None, list[tuple[int, int, int]]]:
        if not self.waiting.exists():
            return 0, None, []
        number, timer, spans = self.waiting.get()
        return number, timer, list(map(tuple, np.frombuffer(bytes(spans), np.int64).reshape(-1, 3).tolist()))

    def _write(self, number: int, timer: int | None, spans: list[tuple[int, int, int]]) -> None:
        """Keeps the spans and sets the timer for the oldest row, if it is not the one set."""
        oldest = min((first // 1000 for _, first, _ in spans), default=None)
        if oldest != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if oldest is not None:
                self.handle.registerTimer(oldest)
        self.waiting.update((number, oldest, np.array(spans, np.int64).tobytes()))

    def _keep(self, rows: pa.Table, number: int, spans: list[tuple[int, int, int]]) -> int:
        """Stores ordered rows as chunks; the next chunk's number."""
        for at in range(0, len(rows), CHUNK_ROWS):
            part = rows.slice(at, CHUNK_ROWS)
            self.chunks.updateValue((number,), (_packed(part),))
            spans.append((number, part["t"][0].as_py(), len(part)))
            number += 1
        return number

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        number, timer, spans = self._read()
        run, held = [], 0
        for pdf in rows:
            is_late = (pdf["micros"] < mark) & (mark > 0)
            if is_late.any():
                late = pdf[is_late]
                columns = zip(late["micros"].tolist(), late["event_id"].tolist(), late["price"].tolist())
                yield _frame([(key[0], "late", t, i, None, None, p, None, None, None) for t, i, p in columns])
            fresh = pdf[~is_late]
            ids = pa.array(fresh["event_id"], pa.string(), from_pandas=True)
            columns = {
                "t": pa.array(fresh["micros"].to_numpy(np.int64)),
                "id": ids.cast(pa.int64()) if self.whole_ids else ids,
                "price": pa.array(fresh["price"].to_numpy(np.float64)),
            }
            run.append(pa.table(columns))
            held += len(fresh)
            if held >= RUN_ROWS:
                number = self._keep(_ordered(pa.concat_tables(run)), number, spans)
                run, held = [], 0
        if held:
            number = self._keep(_ordered(pa.concat_tables(run)), number, spans)
        self._write(number, timer, spans)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        number, _, spans = self._read()
        spans.sort(key=lambda span: span[1])
        due = [span for span in spans if span[1] < mark]
        left = spans[len(due) :]
        tail, held = list(map(tuple, self.tail.get())), None
        for k, (chunk, _, _) in enumerate(due, 1):
            read = _unpacked(self.chunks.getValue((chunk,))[0])
            self.chunks.removeKey((chunk,))
            held = read if held is None else pa.concat_tables([held, read])
            # Rows before the next chunk's first row are all there.
            until = due[k][1] if k < len(due) else mark
            closed = _ordered(held.filter(pc.less(held["t"], until)))
            held = held.filter(pc.greater_equal(held["t"], until))
            if len(closed):
                found, tail = judge(tail, _rows(closed), self.length, self.zscore, self.jump)
                if found:
                    yield _frame([(key[0], *row) for row in found])
        if held is not None and len(held):
            number = self._keep(_ordered(held), number, left)
        self.tail.put(tail)
        self._write(number, None, left)  # Spark deletes the timer that fired

    def close(self) -> None:
        pass


def start_price_rules(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    delay: str,
    length: int = 20,
    zscore: float | None = 3.0,
    jump: float | None = 0.5,
    every: str | None = None,
) -> StreamingQuery:
    """Write anomalies and late rows of the stream as parquet below ``path``.

    A row waits until the watermark (newest time minus ``delay``) has passed it; rows
    already behind it are written as late. Null prices are left out; a null ticker is a
    ticker of its own.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    whole_ids = isinstance(stream.schema["event_id"].dataType, T.IntegralType)
    rows = stream.select(
        "ticker",
        "event_time",
        F.unix_micros("event_time").alias("micros"),
        F.col("event_id").cast("string").alias("event_id"),
        F.col("price").cast("double").alias("price"),
    )
    judged = (
        rows.where(F.col("price").isNotNull() & F.col("event_time").isNotNull())
        .withWatermark("event_time", delay)
        .groupBy("ticker")
        .transformWithStateInPandas(PriceRules(length, zscore, jump, whole_ids), OUT, "Append", "EventTime")
    )
    writer = judged.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.outputMode("append").start()


def read_anomalies(spark: SparkSession, path: str) -> DataFrame:
    """The anomaly records, evidence as a map of the rule's numbers."""
    found = spark.read.schema(OUT).parquet(path).where("kind = 'anomaly'")
    zscore = F.create_map(F.lit("price"), "price", F.lit("mean"), "mean", F.lit("deviation"), "deviation")
    jump = F.create_map(F.lit("price"), "price", F.lit("previous"), "previous")
    return found.select(
        F.lit(EVENT_TYPE).alias("event_type"),
        F.timestamp_micros("micros").alias("event_time"),
        "ticker",
        "rule",
        "score",
        F.when(F.col("rule") == "price_zscore", zscore).otherwise(jump).alias("evidence"),
    )


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came behind the watermark, which no rule has seen."""
    late = spark.read.schema(OUT).parquet(path).where("kind = 'late'")
    return late.select("ticker", F.timestamp_micros("micros").alias("event_time"), "event_id", "price")

