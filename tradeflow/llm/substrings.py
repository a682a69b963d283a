"""Substring dedup: join documents on winnowed anchors, extend, keep maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import binary, covered_words, space_words, staged, window_hashes, word_hashes

#: Words of the shortest repeat, and of an anchor.
REPEAT_WORDS = 13
ANCHOR_WORDS = 5

_DOC = "struct<n_words:bigint,kept_sha256:string,packed:binary>"


@dataclass
class Seeds:
    """One text: its anchors, the stretch of words that each is the anchor of, its windows.

    An anchor is the hash of a run of ANCHOR_WORDS words that is the least in some window
    of `size` words, so equal windows have equal anchors. Consecutive windows with one
    anchor make a stretch.
    """

    words: list[bytes]
    hashes: np.ndarray
    anchors: np.ndarray  # by stretch
    first: np.ndarray  # first and last window of a stretch
    last: np.ndarray

    @classmethod
    def of(cls, text: bytes | None, size: int) -> Seeds:
        words = space_words(text)
        hashes = word_hashes(words)
        none = np.empty(0, np.int64)
        if len(words) < size:
            return cls(words, hashes, np.empty(0, np.uint64), none, none)
        least, reach = window_hashes(hashes, ANCHOR_WORDS), 1
        span = size - ANCHOR_WORDS + 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        last = np.append(first[1:], len(least)) - 1
        return cls(words, hashes, least[first], first, last)

    def stretches(self, size: int) -> np.ndarray:
        """Hashes of all words that the windows of each stretch cover."""
        raw = self.hashes.tobytes()
        ends = (8 * (self.last + size)).tolist()
        starts = (8 * self.first).tolist()
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(
            (digest(raw[a:b]) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts)
        )


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _rows(df: DataFrame, make, size: int, columns: list[str]) -> DataFrame:
    """Rows of longs and the doc id that `make(seeds, listed)` yields for each packed text."""
    kind = df.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in columns]
            origin = []
            packed = batch.column("p").field("packed").to_pylist()
            listed = batch.column("listed")
            for k, text in enumerate(packed):
                values = listed[k].values.to_numpy(zero_copy_only=False)
                made = make(Seeds.of(opened.decompress(text), size), values.view(np.uint64))
                origin.append(np.full(len(made[0]), k))
                for part, column in zip(parts, made, strict=True):
                    part.append(_signed(column))
            where = np.concatenate([*origin, np.empty(0, np.int64)]).astype(np.int64)
            arrays = [pa.array(np.concatenate([*part, np.empty(0, np.int64)])) for part in parts]
            doc = batch.column("doc").take(pa.array(where))
            yield pa.RecordBatch.from_arrays([*arrays, doc], [*columns, "doc"])

    schema = ", ".join(f"{c} long" for c in columns)
    return df.select("doc", "p", "listed").mapInArrow(run, f"{schema}, doc {kind}")


def _anchor_rows(docs: DataFrame, size: int, with_doc: bool) -> DataFrame:
    """Distinct anchors of each row; or distinct (anchor, stretch) pairs with the row's id."""
    kind = docs.schema["doc"].dataType.simpleString()
    schema = f"a long, c long, doc {kind}" if with_doc else "a long"
    empty = np.empty(0, np.uint64)

    def pairs(found: Seeds) -> np.ndarray:
        both = np.stack([found.anchors, found.stretches(size)])
        return np.unique(both, axis=1) if len(np.unique(both[1])) < both.shape[1] else both

    def run(batches):
        for batch in batches:
            seeds = (Seeds.of(text, size) for text in binary(batch, "text"))
            if not with_doc:
                anchors = np.concatenate([*(np.unique(found.anchors) for found in seeds), empty])
                yield pa.RecordBatch.from_arrays([pa.array(_signed(anchors))], ["a"])
                continue
            made = [pairs(found) for found in seeds]
            columns = [np.concatenate([*(part[k] for part in made), empty]) for k in (0, 1)]
            origin = np.repeat(np.arange(len(made)), [part.shape[1] for part in made]).astype(np.int64)
            doc = batch.column("doc").take(pa.array(origin))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(_signed(column)) for column in columns), doc], ["a", "c", "doc"]
            )

    return docs.mapInArrow(run, schema)


def _packed(docs: DataFrame, size: int) -> DataFrame:
    """(doc, p): word count, digest of the whole text, and the text compressed once."""
    kind = docs.schema["doc"].dataType.simpleString()
    shape = pa.struct([("n_words", pa.int64()), ("kept_sha256", pa.string()), ("packed", pa.binary())])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for text in binary(batch, "text"):
                words = space_words(text)
                rows.append(
                    {
                        "n_words": len(words),
                        "kept_sha256": hashlib.sha256(b" ".join(words)).hexdigest(),
                        "packed": pack.compress(text or b""),
                    }
                )
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(rows, shape)], ["doc", "p"])

    return docs.mapInArrow(run, f"doc {kind}, p {_DOC}")


def _listed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The values of each document; there are no more than its text has words."""
    return rows.groupBy("doc").agg(F.collect_set(value).alias(name))


def remove_repeats(
    docs: DataFrame,
    size: int = REPEAT_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text) of each row.

    A word goes if it is in a window of `size` words that a document with a smaller id
    has too; all windows are judged on the input, so overlapping ones form maximal
    repeats. Kept words are joined by one space. Null and empty texts have no words;
    rows with a null id keep all theirs and take nothing from others; rows with the
    same id never count against each other. Other columns do not matter.

    Seeds: anchors of all windows are counted (partial sums before the shuffle), and
    those in two rows or more are joined back to documents. Extension: the whole
    stretch of words around a shared anchor is compared first, which settles copies and
    the inside of passages; where an anchor has several different stretches, the windows
    of each are compared at the first document that has it. Only hashes and ids are
    grouped, by minimum, so a passage in a third of all documents is neither collected
    nor paired. Keys are two 64-bit hashes of different parts of a stretch. Texts are
    shuffled once, compressed, by id.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    named = rows.filter("doc is not null")
    counted = _anchor_rows(named, size, False).groupBy("a").agg(F.count("*").alias("n"))
    shared = staged(counted.filter("n > 1").select("a"), "anchors")
    held = staged(_anchor_rows(named, size, True).join(shared, "a"), "stretches")
    firsts = staged(held.groupBy("a", "c").agg(F.min("doc").alias("first")), "firsts")
    whole = held.join(firsts, ["a", "c"]).filter("first < doc")
    several = firsts.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
    open_ = _listed(firsts.join(several, "a").withColumn("doc", F.col("first")), F.col("a"), "listed")
    texts = _packed(rows, size)

    def windows(found: Seeds, listed: np.ndarray):
        which = np.flatnonzero(np.isin(found.anchors, listed))
        lengths = found.last[which] - found.first[which] + 1
        starts = np.repeat(found.first[which] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        hashes = window_hashes(found.hashes, size)
        pairs = np.stack([np.repeat(found.anchors[which], lengths), hashes[starts.astype(np.int64)]])
        return np.unique(pairs, axis=1) if len(starts) else pairs

    judged = _rows(texts.join(open_, "doc"), windows, size, ["a", "w"])
    earliest = judged.groupBy("a", "w").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    partly = judged.join(earliest.filter("first < last").drop("last"), ["a", "w"]).filter("first < doc")
    repeats = (
        texts.join(_listed(whole, F.col("c"), "stretches"), "doc", "left")
        .join(_listed(partly, F.col("w"), "windows"), "doc", "left")
        .select("doc", "p", "stretches", "windows")
    )
    return _without_repeats(repeats, size, id_col, with_text)


def _without_repeats(repeats: DataFrame, size: int, id_col: str, with_text: bool) -> DataFrame:
    kind = repeats.schema["doc"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string"

    def covered(found: Seeds, stretches: list | None, windows: list | None) -> np.ndarray:
        starts = [np.empty(0, np.int64)]
        if stretches:
            gone = np.isin(_signed(found.stretches(size)), stretches)
            starts += [np.arange(found.first[k], found.last[k] + 1) for k in np.flatnonzero(gone)]
        if windows:
            starts.append(np.flatnonzero(np.isin(_signed(window_hashes(found.hashes, size)), windows)))
        return covered_words(len(found.words), np.concatenate(starts), size)

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            counts, removed, digests, texts = [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("p", "stretches", "windows")]
            for p, stretches, windows in zip(*columns, strict=True):
                gone, digest, kept = 0, p["kept_sha256"], None
                if stretches or windows:
                    found = Seeds.of(opened.decompress(p["packed"]), size)
                    out = covered(found, stretches, windows)
                    gone = int(out.sum())
                    kept = b" ".join(w for w, x in zip(found.words, out.tolist(), strict=True) if not x)
                    digest = hashlib.sha256(kept).hexdigest()
                elif with_text:
                    kept = b" ".join(space_words(opened.decompress(p["packed"])))
                counts.append(p["n_words"])
                removed.append(gone)
                digests.append(digest)
                texts.append(kept)
            made = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names = [id_col, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                made.append(pa.array(texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *made], names)

    return repeats.mapInArrow(run, schema + (", kept_text string" if with_text else ""))
