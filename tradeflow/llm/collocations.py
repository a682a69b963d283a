"""Phrase collocations: Apriori levels over a broadcast double-array trie of frequent phrases.

Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line breaks, and pieces
into words at spaces and tabs. Per language (null: ``und``):

1. Words are counted by tasks and summed by Spark; n is the sum of all of a language's
   words. Words seen ``MIN_COUNT`` times or more get ids, most frequent first, and every
   text becomes an array of those ids, any run of other words and piece ends being one -1.
   Texts without two ids in a row go, as they hold no phrase.
2. Level L = 2..5: the frequent phrases of L-1 words are the nodes of a double-array trie
   (a child of node s by word c sits at base[s] + c where check holds s), broadcast to the
   tasks. Numpy advances the state of every text position of a batch at once, one word a
   step, L-1 steps. A position whose phrase of L-1 words and whose next position's phrase
   of L-1 words are both nodes (the Apriori-safe ones) adds its last word to its state;
   those (state, word) pairs are counted with ``numpy.unique`` per batch, Spark sums the
   shards, and pairs seen ``MIN_COUNT`` times become children in the trie. A level without
   any ends the climb.
3. Every cut of a phrase into a first part and a rest gives floor(1000 a n / (l r)) in
   decimal arithmetic; the lowest, then the shortest first part, counts. A phrase is
   dropped when a longer frequent phrase holds it with as many occurrences. Each
   language's best ``TOP`` by score, a and phrase (UTF-8 order) are ranked.

The trie holds only phrases seen ``MIN_COUNT`` times, so it has at most 5 n / MIN_COUNT
nodes for n words, and its two arrays are checked against ``MAX_TRIE_BYTES`` before they
are broadcast.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .texts import staged

#: Fixed values of the query's contract.
MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: The largest trie that is sent to every task.
MAX_TRIE_BYTES = 1 << 30
#: Words whose states a task holds at once, and counted words it holds before it hands them on.
SLICE_WORDS = 1 << 18
HELD_WORDS = 1 << 17

_CUTS = re.compile(rb"[.,;:!?\x0a-\x0d]")
_LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def pieces(text: bytes | None) -> list[list[bytes]]:
    """Words of each piece of a text; none for null."""
    if not text:
        return []
    return [piece.split() for piece in _CUTS.split(text.translate(_LOWER_AZ))]


def _langs(batch: pa.RecordBatch) -> list[str]:
    return [lang if lang is not None else "und" for lang in batch.column("lang").to_pylist()]


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word binary, f) of all words; tasks add up HELD_WORDS different words before Spark does."""

    def counted(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in seen], pa.string()),
                pa.array([k[1] for k in seen], pa.binary()),
                pa.array(list(seen.values()), pa.int64()),
            ],
            ["lang", "word", "f"],
        )

    def count(batches):
        for batch in batches:
            seen = Counter()
            for lang, text in zip(_langs(batch), _texts(batch), strict=True):
                for words in pieces(text):
                    seen.update((lang, w) for w in words)
                if len(seen) >= HELD_WORDS:
                    yield counted(seen)
                    seen = Counter()
            yield counted(seen)

    return docs.mapInArrow(count, "lang string, word binary, f bigint").groupBy("lang", "word").agg(
        F.sum("f").alias("f")
    )


class DoubleArray:
    """A trie in two arrays: child of s by label c at t = base[s] + c when check[t] == s."""

    def __init__(self, labels: int):
        size = labels + 1
        self.base = np.zeros(size, np.int64)
        self.check = np.full(size, -1, np.int64)
        self.check[0] = -2
        self.free = 1

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def add_children(self, parent: int, labels: np.ndarray) -> np.ndarray:
        """Slots of the children of parent by sorted distinct labels (>= 1), placed first-fit."""
        while True:
            self._grow(self.free + 1)
            if self.check[self.free] == -1:
                break
            self.free += 1
        start = self.free
        while True:
            window = np.arange(start, start + 4096)
            self._grow(int(window[-1]) + int(labels[-1]) + 1)
            bases = window[self.check[window] == -1] - labels[0]
            bases = bases[bases >= 1]
            for label in labels[1:]:
                bases = bases[self.check[bases + label] == -1]
            if len(bases):
                b = int(bases[0])
                slots = b + labels
                self.base[parent] = b
                self.check[slots] = parent
                return slots
            start += 4096

    def nbytes(self) -> int:
        return self.base.nbytes + self.check.nbytes


def step(base: np.ndarray, check: np.ndarray, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The state after each label, -1 where there is no child or no state."""
    ok = (states >= 0) & (labels >= 0)
    t = np.where(ok, base[np.where(ok, states, 0)] + labels, 0)
    ok &= t < len(check)
    t = np.where(ok, t, 0)
    return np.where(ok & (check[t] == states), t, -1)


def flat_ids(column: pa.ListArray) -> np.ndarray:
    """All id arrays of a batch in one, each followed by -1, read from Arrow's buffers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    words = np.full(len(values) + len(column), -1, np.int64)
    words[np.arange(len(values)) + np.repeat(np.arange(len(column)), lengths)] = values
    return words


def slices(column: pa.ListArray):
    """The id arrays in stretches of up to SLICE_WORDS ids, one array at least."""
    offsets, at = column.offsets.to_numpy(), 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_WORDS, "right")) - 1
        end = max(at + 1, end)
        yield column.slice(at, end - at)
        at = end


def extensions(base: np.ndarray, check: np.ndarray, column: pa.ListArray, level: int, width: int) -> np.ndarray:
    """node * width + word of each frequent phrase of level-1 words and the word after it
    that ends another one. Only these outlast a slice of the batch."""
    keys = [np.empty(0, np.int64)]
    for part in slices(column):
        padded = np.concatenate([flat_ids(part), [-1]])
        states = np.zeros(len(padded), np.int64)
        for j in range(level - 1):
            states = step(base, check, states, np.concatenate([padded[j:], np.full(j, -1)]))
        safe = states >= 0
        safe[:-1] &= states[1:] >= 0
        safe[-1] = False
        at = np.flatnonzero(safe)
        keys.append(states[at] * width + padded[at + level - 1])
    return np.concatenate(keys)


def extension_counts(ids: DataFrame, trie, level: int, labels: int) -> DataFrame:
    """(node, word, c): how often a frequent phrase of level-1 words is followed by a word
    that ends another one. A pair is counted as the one number node * (labels + 1) + word."""
    width = labels + 1

    def count(batches):
        base, check = trie.value
        for batch in batches:
            keys, counts = np.unique(extensions(base, check, batch.column("ids"), level, width), return_counts=True)
            if len(keys):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys // width), pa.array(keys % width), pa.array(counts.astype(np.int64))],
                    ["node", "word", "c"],
                )

    return ids.mapInArrow(count, "node bigint, word bigint, c bigint").groupBy("node", "word").agg(
        F.sum("c").alias("c")
    )


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS):
    """(phrases, totals): (lang, words array<binary>, f) of every frequent phrase of 1 to
    max_words words, and (lang, n)."""
    spark = docs.sparkSession
    docs = docs.select("lang", "text")
    words = staged(word_counts(docs), "collocation_words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    vocab = words.filter(F.col("f") >= min_count).orderBy(F.desc("f"), "lang", "word").collect()
    ids = {(r["lang"], r["word"]): k for k, r in enumerate(vocab, 1)}
    langs = [r["lang"] for r in vocab]
    texts = [r["word"] for r in vocab]
    found = {k: (None, k, r["f"]) for k, r in enumerate(vocab, 1)}  # node: (parent, word id, f)
    table = spark.sparkContext.broadcast(ids)

    def to_ids(batches):
        known = table.value
        for batch in batches:
            values, offsets = array("q"), array("q", [0])
            for lang, text in zip(_langs(batch), _texts(batch), strict=True):
                row = array("q")
                for piece in pieces(text):
                    for w in piece:
                        k = known.get((lang, w), -1)
                        if k >= 0 or (row and row[-1] >= 0):
                            row.append(k)
                    if row and row[-1] >= 0:
                        row.append(-1)
                while row and row[-1] < 0:
                    row.pop()
                if any(a >= 0 and b >= 0 for a, b in zip(row, row[1:])):
                    values.extend(row)
                    offsets.append(len(values))
            column = pa.ListArray.from_arrays(
                pa.array(np.frombuffer(offsets, np.int64).astype(np.int32)), pa.array(np.frombuffer(values, np.int64))
            )
            yield pa.RecordBatch.from_arrays([column], ["ids"])

    id_rows = staged(docs.mapInArrow(to_ids, "ids array<bigint>"), "collocation_ids")
    trie = DoubleArray(len(vocab))
    trie.check[1 : len(vocab) + 1] = 0
    level_nodes = list(range(1, len(vocab) + 1))
    for level in range(2, max_words + 1):
        if not level_nodes:
            break
        if trie.nbytes() > MAX_TRIE_BYTES:
            raise ValueError(f"the trie of frequent phrases takes {trie.nbytes()} bytes")
        shared = spark.sparkContext.broadcast((trie.base, trie.check))
        grown = extension_counts(id_rows, shared, level, len(vocab)).filter(F.col("c") >= min_count)
        children: dict[int, list[tuple[int, int]]] = {}
        for r in grown.collect():
            children.setdefault(r["node"], []).append((r["word"], r["c"]))
        shared.unpersist()
        level_nodes = []
        for parent in sorted(children):
            kids = sorted(children[parent])
            slots = trie.add_children(parent, np.array([w for w, _ in kids], np.int64))
            for slot, (w, c) in zip(slots.tolist(), kids, strict=True):
                found[slot] = (parent, w, c)
                level_nodes.append(slot)
    rows = []
    for node, (parent, w, f) in found.items():
        chain = [w]
        while parent is not None:
            parent, w, _ = found[parent]
            chain.append(w)
        chain.reverse()
        rows.append((langs[chain[0] - 1], [texts[k - 1] for k in chain], f))
    phrases = spark.createDataFrame(rows, "lang string, words array<binary>, f bigint")
    return phrases, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to
    max_words words seen min_count times or more.

    Null texts have no words, a null lang is ``und``; repeated rows count each time; other
    columns of docs are not read. No phrase comes from an empty table.
    """
    phrases, totals = frequent_phrases(docs, min_count, max_words)
    phrases = staged(phrases.withColumn("m", F.size("words")), "collocation_phrases")
    f_of = phrases.select("lang", "words", "f")
    cands = phrases.filter("m >= 2").join(totals, "lang")
    cuts = cands.select("lang", "words", "m", F.col("f").alias("a"), "n", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.slice("words", 1, F.col("k"))).withColumn(
        "rest", F.slice("words", F.col("k") + 1, F.col("m") - F.col("k"))
    )
    cuts = cuts.join(f_of.withColumnsRenamed({"words": "head", "f": "l"}), ["lang", "head"]).join(
        f_of.withColumnsRenamed({"words": "rest", "f": "r"}), ["lang", "rest"]
    )
    exact = F.expr("(CAST(1000 AS DECIMAL(38,0)) * a * n) div (CAST(l AS DECIMAL(38,0)) * r)")
    cuts = cuts.withColumn("score", exact.cast("bigint"))
    best = cuts.groupBy("lang", "words").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b")
    ).select("lang", "words", "b.*")
    longer = phrases.filter("m >= 3").select(
        "lang", "f", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("len"), "words", "m"
    ).select(
        "lang", "f", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("len") + 1)).alias("at"), "len", "words"
    ).select("lang", F.slice("words", F.col("at"), F.col("len")).alias("words"), F.col("f").alias("held"))
    holders = longer.groupBy("lang", "words").agg(F.max("held").alias("held"))
    kept = best.join(holders, ["lang", "words"], "left").filter(F.col("held").isNull() | (F.col("held") < F.col("a")))
    kept = kept.withColumn("phrase", F.concat_ws(" ", F.transform("words", lambda w: w.cast("string"))))
    order = Window.partitionBy("lang").orderBy(
        F.desc("score"), F.desc("a"), F.col("phrase").cast("binary")
    )
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
