"""Phrase collocations against counting every phrase by hand."""

import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tradeflow.llm import collocations  # noqa: E402
from tradeflow.llm.collocations import DoubleArray, step  # noqa: E402


def brute(rows, min_count, top=2000):
    grams, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for k in range(len(w) - m + 1):
                    grams[(lang, tuple(w[k : k + m]))] += 1
    freq = {g: f for g, f in grams.items() if f >= min_count}
    out = []
    for (lang, g), a in freq.items():
        if len(g) < 2:
            continue
        held = [f for (l2, h), f in freq.items() if l2 == lang and len(h) > len(g)
                and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
        if any(f >= a for f in held):
            continue
        score, _, l, r = min(
            ((1000 * a * n[lang]) // (freq[(lang, g[:k])] * freq[(lang, g[k:])]), k,
             freq[(lang, g[:k])], freq[(lang, g[k:])]) for k in range(1, len(g))
        )
        out.append((lang, " ".join(g), a, l, r, n[lang], score))
    ranked = []
    for lang in sorted({o[0] for o in out}):
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(o[0], rank, *o[1:]) for rank, o in enumerate(mine[:top], 1)]
    return sorted(ranked)


ROWS = [
    ("en", "New York is big. new york city, NEW YORK CITY hall!"),
    ("en", "new york city hall\tnew york city hall; the the the the"),
    (None, "new york new york"),
    ("de", "new york city"),
    ("en", None),
    ("en", ""),
    ("en", "a b c d e f g a b c d e f g a b c d e f g"),
    ("en", "a b c d e f g a b c d e f g a b c d e f g"),
    ("en", " ".join(["x y"] * 3000)),
]


@pytest.mark.parametrize("min_count", [2, 3, 5])
def test_equals_counting_by_hand_with_ties_repeats_nulls_and_long_texts(spark, min_count):
    docs = spark.createDataFrame(ROWS, "lang string, text string").withColumn("rank", spark_lit(1))
    got = collocations.collocations(docs, min_count=min_count, top=3).collect()
    assert sorted(map(tuple, got)) == brute(ROWS, min_count, top=3)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string, score long")
    assert collocations.collocations(docs).count() == 0


def test_double_array_finds_children_and_nothing_else():
    trie = DoubleArray(5)
    trie.check[1:6] = 0
    a = trie.add_children(1, __import__("numpy").array([2, 5]))
    b = trie.add_children(2, __import__("numpy").array([1, 2, 3, 4, 5]))
    np = __import__("numpy")
    states = np.array([1, 1, 1, 2, 2, 3, -1])
    labels = np.array([2, 5, 3, 4, 1, 1, 1])
    assert step(trie.base, trie.check, states, labels).tolist() == [a[0], a[1], -1, b[3], b[0], -1, -1]
    assert len(set(a) | set(b) | {1, 2, 3, 4, 5}) == 12


def spark_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_states_of_a_batch_are_held_a_slice_at_a_time():
    import tracemalloc

    words, labels = 2_000_000, 50
    trie = collocations.DoubleArray(labels)
    trie.check[1 : labels + 1] = 0
    rng = np.random.default_rng(5)
    flat = np.where(rng.random(words) < 0.9, rng.integers(10, 51, words), rng.integers(1, 10, words))
    known = np.where(flat > 9, -1, flat)  # few pairs, so that the kept keys are small
    column = pa.ListArray.from_arrays(np.arange(0, words + 1, 500, dtype=np.int32), pa.array(known))
    tracemalloc.start()
    keys = collocations.extensions(trie.base, trie.check, column, 2, labels + 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    first, second = known[:-1], known[1:]
    pairs = (first > 0) & (second > 0) & (np.arange(1, words) % 500 != 0)
    assert sorted(keys) == sorted((first * (labels + 1) + second)[pairs])
    assert peak < 8 * words  # one array of all words' states would pass this


def test_words_are_handed_on_before_a_batch_ends(spark, monkeypatch):
    docs = spark.createDataFrame([("en", f"a w{k} w{k}") for k in range(40)], "lang string, text string")
    monkeypatch.setattr(collocations, "HELD_WORDS", 7)
    counts = {bytes(r["word"]).decode(): r["f"] for r in collocations.word_counts(docs).collect()}
    assert counts == {"a": 40, **{f"w{k}": 2 for k in range(40)}}
