"""Importance resampling toward a target distribution, ranked by a distributed LSD radix sort.

Weights: each word is a feature whose bucket is crc32 of its UTF-8 bytes modulo
``BUCKETS``. Tasks count buckets of their texts with ``numpy.bincount`` and Spark sums the
counts of all tasks, for the raw corpus (s, S) and for the target texts (t, T). The gain of
a bucket, floor(1000 * ln((t+1)(S+B) / ((s+1)(T+B)))), is an array of ``BUCKETS`` doubles,
the only thing broadcast; a document's weight is the floored mean of the gains of its
features, read from that array. A Gumbel key from a hash of the id is added, so the highest
scores are a draw without replacement in proportion to exp(weight / 1000).

Ranks: eligible documents are sorted by (score descending, doc_id ascending) with
least-significant-digit radix passes of ``RADIX_BITS`` bits. In each pass every row takes
its digit; rows are in blocks of consecutive positions; counts per (block, digit) and their
prefix sums in (digit, block) order give each block's first place for that digit, and a
row's rank among rows of its block and digit in the present order gives its place after
it, so each pass is a stable counting sort. After the last pass a row's place is its rank.
Each pass is written below the shared folder, so a lost executor costs one pass at most.
A group of one block and one digit holds ``BLOCK_ROWS`` rows at most, however hot a score.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .texts import alnum_words, annotate, binary, staged

#: Fixed values of the query's contract.
BUCKETS = 10_000
MIN_WORDS = 20
DRAW_PERCENT = 10
SEED = "2024"
#: Bits of a digit in one pass and rows of a block of positions.
RADIX_BITS = 8
BLOCK_ROWS = 1 << 20


def bucket_ids(text: bytes | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each word (A-Z lower-cased, runs of ASCII letters, digits and non-ASCII)."""
    words = alnum_words(text)
    return np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts of df: each task adds its texts up, Spark adds the tasks."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in binary(batch, text_col):
                total += np.bincount(bucket_ids(text, buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["bucket", "n"])

    return df.select(text_col).mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(
        F.sum("n").alias("n")
    )


def bucket_gains(raw: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket as doubles; ``buckets`` values come to the driver, whatever the corpus."""
    s = np.zeros(buckets, np.float64)
    t = np.zeros(buckets, np.float64)
    for row in bucket_counts(raw, text_col, buckets).collect():
        s[row["bucket"]] = row["n"]
    for row in bucket_counts(target, text_col, buckets).collect():
        t[row["bucket"]] = row["n"]
    big_s, big_t = float(s.sum()), float(t.sum())
    return np.floor(1000.0 * np.log(((t + 1.0) * (big_s + buckets)) / ((s + 1.0) * (big_t + buckets))))


def gumbel(doc_id: int, seed: str = SEED) -> float:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h the first 32 bits of sha256("seed:id")."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, gains: np.ndarray, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with n_features, weight and score (long); null id: score null."""
    table = docs.sparkSession.sparkContext.broadcast(gains)
    buckets = len(gains)

    def scored(batch: pa.RecordBatch) -> list[pa.Array]:
        gain = table.value
        n, weight, score = [], [], []
        for text, doc in zip(binary(batch, text_col), batch.column(id_col).to_pylist(), strict=True):
            ids = bucket_ids(text, buckets)
            w = int(math.floor(float(gain[ids].sum()) / len(ids))) if len(ids) else 0
            n.append(len(ids))
            weight.append(w)
            score.append(None if doc is None else w + gumbel(doc))
        return [pa.array(n, pa.int64()), pa.array(weight, pa.int64()), pa.array(score, pa.int64())]

    return annotate(docs, {"n_features": "bigint", "weight": "bigint", "score": "bigint"}, scored)


def _pass(recs: DataFrame, digit: F.Column, block: F.Column, order: str) -> DataFrame:
    """One stable counting-sort pass: the new place `pos` of every row by `digit`."""
    r = recs.withColumn("digit", digit).withColumn("block", block)
    counts = r.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("digit").agg(F.sum("c").alias("c"))
    first_of_digit = totals.select(
        "digit", F.coalesce(F.sum("c").over(earlier.orderBy("digit")), F.lit(0)).alias("digit_start")
    )
    starts = counts.select(
        "block", "digit", F.coalesce(F.sum("c").over(earlier.partitionBy("digit").orderBy("block")), F.lit(0)).alias("block_start")
    ).join(F.broadcast(first_of_digit), "digit")
    local = F.row_number().over(Window.partitionBy("block", "digit").orderBy(order)) - 1
    placed = r.withColumn("local", local).join(starts, ["block", "digit"])
    return placed.select("row", "high", "low", (F.col("digit_start") + F.col("block_start") + F.col("local")).alias("pos"))


def radix_ranks(keys: DataFrame, radix_bits: int = RADIX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, pos) for rows (row, high, low) of non-negative longs, pos 0.. by (high, low), stable.

    The number of passes follows the bits that the largest high and low take.
    """
    top = keys.agg(F.max("high").alias("h"), F.max("low").alias("l")).first()
    high_bits = int(top["h"] or 0).bit_length()
    low_bits = int(top["l"] or 0).bit_length()
    passes = [("low", shift) for shift in range(0, low_bits, radix_bits)]
    passes += [("high", shift) for shift in range(0, high_bits, radix_bits)]
    passes = passes or [("low", 0)]  # one pass at least makes places gapless
    mask = (1 << radix_bits) - 1
    # Written once, so every branch of the first pass sees the same first places.
    recs = staged(keys.withColumn("pos", F.monotonically_increasing_id()), "radix_in")
    block = F.shiftright("pos", 33)
    for number, (part, shift) in enumerate(passes):
        digit = F.shiftright(part, shift).bitwiseAND(F.lit(mask))
        recs = staged(_pass(recs, digit, block, "pos"), f"radix{number}")
        block = F.floor(F.col("pos") / F.lit(block_rows))
    return recs.select("row", "pos")


def resample(
    docs: DataFrame,
    target: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    min_words: int = MIN_WORDS,
    percent: int = DRAW_PERCENT,
) -> DataFrame:
    """Every row of docs with n_features, weight, score and rank (long; undrawn: null).

    Of the N rows with at least `min_words` words and an id, floor(percent * N / 100) of
    highest score are drawn, ties to the smaller id, then to the earlier row of the input;
    rank counts them from 1. Null or empty texts have no features and weight 0; a null id
    gives a null score and is never drawn. Repeated rows are ranked each. Columns of docs
    named like a result give way to it.
    """
    gains = bucket_gains(docs, target, text_col)
    scored = staged(weigh(docs, gains, text_col, id_col).withColumn("_row", F.monotonically_increasing_id()), "weighed")
    eligible = scored.filter((F.col("n_features") >= min_words) & F.col("score").isNotNull())
    bounds = eligible.agg(F.max("score").alias("s"), F.min(id_col).alias("i"), F.count(F.lit(1)).alias("n")).first()
    drawn = (percent * int(bounds["n"])) // 100
    keys = eligible.select(
        F.col("_row").alias("row"),
        (F.lit(bounds["s"] if bounds["s"] is not None else 0) - F.col("score")).alias("high"),
        (F.col(id_col) - F.lit(bounds["i"] if bounds["i"] is not None else 0)).alias("low"),
    )
    ranks = radix_ranks(keys).filter(F.col("pos") < drawn).select(
        F.col("row").alias("_row"), (F.col("pos") + 1).alias("rank")
    )
    out = scored.drop("rank").join(ranks, "_row", "left")
    return out.select(*[c for c in scored.columns if c not in ("_row", "rank")], "rank")
