"""Words, hashes, Arrow passes and written steps that the operators here share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeflow.session import work_dir

_LOWER_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(32)


def space_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space; none for null."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """The same with A-Z in lower case."""
    return text.lower().split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and all bytes over 127, A-Z in lower case."""
    return text.translate(_LOWER_ALNUM).split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` word hashes; empty where there are fewer."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, size):
        out *= _ODD
        out += hashes[k : k + count]
    out ^= out >> _TURN
    out *= _ODD
    return out ^ (out >> _TURN)


def runs(covered: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def covered_words(count: int, starts: Iterable[int], size: int) -> np.ndarray:
    """Which of `count` words lie in a window of `size` words that begins at one of starts."""
    change = np.zeros(count + 1, np.int32)
    at = np.fromiter(starts, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + size, count), -1)
    return np.cumsum(change[:-1]) > 0


def binary(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def other_columns(df: DataFrame, results: Iterable[str]) -> list[str]:
    """Columns of df whose names no result column takes; names differ by more than case."""
    taken = {name.lower() for name in results}
    return [name for name in df.columns if name.lower() not in taken]


def annotate(
    df: DataFrame,
    results: dict[str, str],
    function: Callable[..., list],
    keep: Iterable[str] | None = None,
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """df with columns that `function` makes of each Arrow batch, one value for each row.

    `setup` runs once in each task; what it returns is given to every call. A column of df with the name of a result gives way to it. `keep` names the
    columns of df to be returned, all by default.
    """
    kept = [c for c in other_columns(df, results) if keep is None or c in set(keep)]
    types = {name: df.schema[name].dataType.simpleString() for name in kept}
    schema = ", ".join(f"`{name}` {kind}" for name, kind in (types | results).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            made = function(batch, *state)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), *made], [*kept, *results]
            )

    return df.mapInArrow(run, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written below the shared folder and read again: lost executors cost no rework."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_as_string(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
