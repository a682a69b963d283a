"""Importance resampling against a plain reading of its contract, and the radix sort alone."""

import math
import random
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tradeflow.llm import resampling  # noqa: E402
from tradeflow.llm.queries import queries  # noqa: E402
from tradeflow.llm.texts import alnum_words  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def brute(docs, items, min_words=20, percent=10):
    """[(doc_id, n_features, weight, score, rank)] in input order, straight from the contract."""
    words = lambda t: alnum_words(t.encode()) if t else []
    s, t = [0] * 10000, [0] * 10000
    for _, text in docs:
        for w in words(text):
            s[zlib.crc32(w) % 10000] += 1
    for _, text in items:
        for w in words(text):
            t[zlib.crc32(w) % 10000] += 1
    big_s, big_t = float(sum(s)), float(sum(t))
    gain = [
        math.floor(1000 * math.log(((t[b] + 1.0) * (big_s + 10000)) / ((s[b] + 1.0) * (big_t + 10000))))
        for b in range(10000)
    ]
    out = []
    for doc, text in docs:
        bs = [zlib.crc32(w) % 10000 for w in words(text)]
        weight = math.floor(sum(float(gain[b]) for b in bs) / len(bs)) if bs else 0
        score = None if doc is None else weight + resampling.gumbel(doc)
        out.append([doc, len(bs), weight, score, None])
    eligible = [k for k, r in enumerate(out) if r[1] >= min_words and r[3] is not None]
    eligible.sort(key=lambda k: (-out[k][3], out[k][0], k))
    for rank, k in enumerate(eligible[: percent * len(eligible) // 100], 1):
        out[k][4] = rank
    return [tuple(r) for r in out]


def test_query_equals_the_contract_on_small_tables(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries()["op12_importance_resampling"](spark, SMALL).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(brute(docs, items), key=lambda r: r[0])
    assert sum(r["rank"] is not None for r in got) == sum(r[1] >= 20 for r in got) // 10


@pytest.mark.parametrize("bits, block", [(8, 1 << 20), (3, 7), (1, 2)])
def test_radix_sort_is_a_stable_sort(spark, bits, block):
    rng = random.Random(bits)
    rows = [(k, rng.choice([0, 1, 5, 300, 2**40]), rng.randrange(50)) for k in range(300)]
    keys = spark.createDataFrame(rows, "row long, high long, low long").repartition(5)
    got = dict(resampling.radix_ranks(keys, bits, block).collect())
    assert sorted(got.values()) == list(range(300))
    order = sorted(got, key=got.get)
    assert [(rows[k][1], rows[k][2]) for k in order] == sorted((h, l) for _, h, l in rows)


def test_messy_rows_ties_repeats_nulls_clashing_columns_and_empty_tables(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    rows = [(None, long), (1, None), (2, ""), (3, long), (3, long), (4, "a " * 25)]
    rows += [(k, " ".join(f"v{(k * j) % 37}" for j in range(30))) for k in range(5, 40)]
    items = [(1, "w1 w2 w3 v1 v2"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", spark_lit("x"))
    docs = docs.withColumn("score", docs["doc_id"])
    target = spark.createDataFrame(items, "item_id long, text string")
    got = resampling.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, items), key=str)
    empty = resampling.resample(docs.limit(0), target)
    assert empty.count() == 0


def spark_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)
