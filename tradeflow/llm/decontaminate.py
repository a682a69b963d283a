"""Benchmark decontamination: a broadcast set of test n-grams against every word window."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import (
    alnum_words,
    annotate,
    binary,
    covered_words,
    other_columns,
    runs,
    staged,
    window_hashes,
    word_hashes,
)

#: Words of a window.
WINDOW = 10
#: Windows of the benchmark that one broadcast may hold; 200,000 take about 40 MB.
BROADCAST_WINDOWS = 200_000
_FILTER_BITS = 20


def benchmark_windows(
    benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """Distinct (item, n, words) of all items; words are joined by one space.

    An item of fewer words than `size` is one window, one without words has none. Rows
    with the same id are one item. An item with a null id keeps its windows, so its words
    hit documents, but it is listed nowhere.
    """

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {"item": [], "n": [], "words": []}
            for item, text in zip(batch.column("item").to_pylist(), binary(batch, "text")):
                words = alnum_words(text)
                n = min(size, len(words))
                for start in range(len(words) - n + 1 if n else 0):
                    rows["item"].append(item)
                    rows["n"].append(n)
                    rows["words"].append(b" ".join(words[start : start + n]))
            yield pa.RecordBatch.from_pydict(
                rows, pa.schema([("item", pa.string()), ("n", pa.int32()), ("words", pa.binary())])
            )

    items = benchmark.select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")
    )
    return items.mapInArrow(run, "item string, n int, words binary").distinct()


class WindowSet:
    """Windows by their words, behind a bit table that drops nearly all others by hash."""

    def __init__(self, rows):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        sizes = defaultdict(list)
        for item, n, words in rows:
            words = bytes(words)
            if words not in self.items:
                sizes[n].append(words.split(b" "))
            self.items[words].append(item)
        self.filters = {}
        for n, windows in sizes.items():
            hashes = word_hashes([w for window in windows for w in window]).reshape(-1, n)
            bits = np.zeros(1 << _FILTER_BITS, bool)
            for row in hashes:
                bits[window_hashes(row, n) >> np.uint64(64 - _FILTER_BITS)] = True
            self.filters[n] = bits

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items of those windows."""
        covered, found = np.zeros(len(words), bool), set()
        hashes = word_hashes(words)
        for n, bits in self.filters.items():
            starts = []
            likely = bits[window_hashes(hashes, n) >> np.uint64(64 - _FILTER_BITS)]
            for start in np.flatnonzero(likely).tolist():
                items = self.items.get(b" ".join(words[start : start + n]))
                if items:
                    starts.append(start)
                    found.update(item for item in items if item is not None)
            if starts:
                covered |= covered_words(len(words), starts, n)
        return covered, found


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    text_col: str = "text",
    keep: list[str] | None = None,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """docs with n_words, leak_runs (word positions [start, end)) and leak_items.

    The windows are counted first. Up to `broadcast_windows` of them are one broadcast
    set and one scan of docs, without a shuffle. A larger benchmark is cut into blocks
    of about that size; each block is a scan that adds its hits to those of the blocks
    before, so the result is the same. Every row is judged alone, so null ids, repeated
    rows and hot sources do not matter; null and empty texts have no words. Columns of
    docs with these names are replaced.
    """
    spark = docs.sparkSession
    windows = staged(benchmark_windows(benchmark, size), "windows")
    blocks = max(1, -(-windows.count() // broadcast_windows))
    results = {
        "n_words": "bigint",
        "leak_runs": "array<struct<start:bigint,end:bigint>>",
        "leak_items": "array<string>",
    }
    kept = [c for c in (keep or docs.columns) if c in other_columns(docs, results)]
    needed = list(dict.fromkeys([*kept, text_col]))
    rows = docs.select(*needed)
    for block in range(blocks):
        part = windows.filter(F.expr(f"pmod(xxhash64(words, item), {blocks})") == block)
        shared = spark.sparkContext.broadcast([tuple(row) for row in part.collect()])
        later = block > 0

        def scan(batch, known, later=later):
            before = batch.column("leak_runs").to_pylist() if later else None
            listed = batch.column("leak_items").to_pylist() if later else None
            counts, spans, items = [], [], []
            for k, text in enumerate(binary(batch, text_col)):
                words = alnum_words(text)
                covered, found = known.hits(words)
                if later:
                    for run in before[k]:
                        covered[run["start"] : run["end"]] = True
                    found |= set(listed[k])
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in runs(covered)])
                items.append(sorted(found))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return [pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]

        last = block == blocks - 1
        names = kept if last else needed
        rows = annotate(rows, results, scan, names, lambda shared=shared: WindowSet(shared.value))
        if not last:
            rows = staged(rows, "leaks")
    return rows


def leak_report(leaks: DataFrame) -> DataFrame:
    """The counts of find_leaks, with the items as a digest of their ids in order."""
    hit = F.aggregate(
        "leak_runs", F.lit(0).cast("bigint"), lambda total, run: total + run["end"] - run["start"]
    )
    kept = other_columns(
        leaks, ["leak_runs", "leak_items", "n_hit", "n_items", "items_sha256", "contaminated"]
    )
    return leaks.select(
        *kept,
        hit.alias("n_hit"),
        F.size("leak_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("leak_items", ","), 256).alias("items_sha256"),
        (F.size("leak_runs") > 0).alias("contaminated"),
    )


def drop_leaking_documents(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text"
) -> DataFrame:
    """docs without those that hold a window of the benchmark."""
    found = find_leaks(docs, benchmark, size, text_col)
    return found.filter(F.size("leak_runs") == 0).select(*[c for c in docs.columns if c in found.columns])


def cut_leaking_spans(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text"
) -> DataFrame:
    """docs whose hit words are gone from the text; what lies between two words stays once.

    Texts without hits stay as they are.
    """
    found = find_leaks(docs, benchmark, size, text_col)

    def cut(batch):
        out = []
        for text, spans in zip(binary(batch, text_col), batch.column("leak_runs").to_pylist()):
            if spans:
                text = _without_words(text, [(s["start"], s["end"]) for s in spans])
            out.append(text)
        return [pa.array(out, pa.binary()).cast(pa.string())]

    return annotate(found, {text_col: "string"}, cut, docs.columns).select(*docs.columns)


def _without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    inside = np.frombuffer(b"".join(b"\1" if len(alnum_words(bytes([b]))) else b"\0" for b in range(256)), bool)
    places = runs(inside[np.frombuffer(text, np.uint8)])
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])
