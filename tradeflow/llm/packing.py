"""Best-fit packing: token pieces of documents in sequences under several capacities."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import text_as_string

#: Fixed vocabulary name.
VOCABULARY = "byte_bpe_50k"
END = 0
_SPECIAL = "<|endoftext|>"
#: Beyond these characters Unicode tables of the two libraries might differ.
_RARE = re.compile("[^\x00-ɏ‐-‧€]")
_LONG = 1_000_000


class Encoder:
    """Token ids as the vocabulary's tokenizer gives them.

    The rank file of the same vocabulary gives the same ids four times faster. Texts
    with rare characters or the special token, and very long ones, go to the tokenizer.
    """

    def __init__(self, folder: str):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_file(f"{folder}/{VOCABULARY}.json")
        with open(f"{folder}/{VOCABULARY}.tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding(
            VOCABULARY, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str) -> list[int]:
        if len(text) > _LONG or _SPECIAL in text or _RARE.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def tokenizer_folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(f"{VOCABULARY}.json"))


def token_pieces(
    docs: DataFrame,
    tokens: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32 and, if asked for, ids) of each row.

    The ids of a text, then END. Only documents over `tokens` are cut: all pieces have
    that length but the first, which takes the remainder. Null and empty texts are one
    piece that holds END.
    """
    folder = folder or tokenizer_folder()
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    arrow = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        schema, arrow = f"{schema}, ids array<int>", [*arrow, ("ids", pa.list_(pa.int32()))]

    def cut(batches):
        encoder = Encoder(folder)
        for batch in batches:
            rows: list[list] = [[] for _ in arrow]
            origin: list[int] = []
            for k, text in enumerate(batch.column(text_col).to_pylist()):
                ids = np.array([*encoder.ids(text or ""), END], "<u4")
                start, piece = 0, 0
                end = len(ids) % tokens or min(tokens, len(ids))
                while start < len(ids):
                    part = ids[start:end]
                    origin.append(k)
                    values = [piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32)]
                    for column, value in zip(rows, values, strict=False):
                        column.append(value)
                    start, end, piece = end, end + tokens, piece + 1
            made = [pa.array(column, kind) for column, (_, kind) in zip(rows, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(origin, pa.int64())), *made],
                [id_col, *(name for name, _ in arrow)],
            )

    return text_as_string(docs.select(id_col, text_col), text_col).mapInArrow(cut, schema)


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold, and how much each residual weighs in the choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    measure: str = "norm"  # or "dot"


class BestFit:
    """Open sequences of one task; each piece goes to the best of all that can take it.

    Sequences with equal tokens and documents left share a cell, ordered by the attention
    they have left. Of those that can take a piece, the one with least attention left is a
    cell's best by "norm", the one with most by "dot", so one value a cell is compared.
    """

    def __init__(self, capacity: Capacity):
        self.capacity = capacity
        self.count = 0
        self.cells: dict[tuple[int, int], int] = {}  # (tokens, documents) left: place in the arrays
        self.held: list[list[tuple[int, int]]] = []  # (attention left, sequence), in order
        self.spare: list[int] = []  # places without sequences
        #: Tokens, documents and the best attention of each cell; no tokens where it is empty.
        self.tokens, self.documents, self.attention = np.zeros((3, 64))

    def _changed(self, k: int) -> None:
        """The arrays follow the sequences of cell k."""
        held = self.held[k]
        if held:
            self.attention[k] = held[0 if self.capacity.measure != "dot" else -1][0]
        else:
            del self.cells[int(self.tokens[k]), int(self.documents[k])]
            self.tokens[k] = 0
            self.spare.append(k)

    def _add(self, tokens: int, documents: int, attention: int, sequence: int) -> None:
        k = self.cells.get((tokens, documents))
        if k is None:
            if self.spare:
                k = self.spare.pop()
            else:
                k = len(self.held)
                self.held.append([])
                if k == len(self.tokens):
                    grown = (np.concatenate([a, np.zeros(k)]) for a in (self.tokens, self.documents, self.attention))
                    self.tokens, self.documents, self.attention = grown
            self.cells[tokens, documents] = k
            self.tokens[k], self.documents[k] = tokens, documents
        insort(self.held[k], (attention, sequence))
        self._changed(k)

    def _best(self, length: int) -> tuple[int, int] | None:
        """Cell and place in it of the best open sequence that can take a piece."""
        n, cost = len(self.held), length * length
        places = np.flatnonzero(self.tokens[:n] >= length)
        if not len(places):
            return None
        tokens, documents, attention = self.tokens[places], self.documents[places], self.attention[places]
        # Where a cell's best attention is too little, no other in it is better than just enough.
        values = self._better(tokens, documents, np.maximum(attention, cost), length)
        while True:
            k = int(np.argmin(values))
            if np.isinf(values[k]):
                return None
            cell = int(places[k])
            held = self.held[cell]
            if attention[k] >= cost:
                return cell, (bisect_left(held, (int(attention[k]),)))
            at = bisect_left(held, (cost,))
            if at == len(held):
                values[k] = np.inf
            else:
                attention[k] = held[at][0]
                values[k] = self._better(tokens[k], documents[k], attention[k], length)

    def _better(self, tokens, documents, attention, length: int):
        """Lower is better: what stays free after the piece, or minus the alignment."""
        c, (wt, wd, wa) = self.capacity, self.capacity.weights
        if self.capacity.measure == "dot":
            return -(
                wt * tokens * length / c.tokens**2
                + wd * documents / c.documents**2
                + wa * attention * length * length / c.attention**2
            )
        return (
            wt * ((tokens - length) / c.tokens) ** 2
            + wd * ((documents - 1) / c.documents) ** 2
            + wa * ((attention - length * length) / c.attention) ** 2
        )

    def place(self, length: int) -> tuple[int, int]:
        """The sequence for a piece, and its offset there."""
        c, chosen = self.capacity, self._best(length)
        if chosen is None:
            sequence, tokens, documents, attention = self.count, c.tokens, c.documents, c.attention
            self.count += 1
        else:
            k, at = chosen
            tokens, documents = int(self.tokens[k]), int(self.documents[k])
            attention, sequence = self.held[k].pop(at)
            self._changed(k)
        offset = c.tokens - tokens
        tokens, documents, attention = tokens - length, documents - 1, attention - length * length
        if tokens and documents and attention:
            self._add(tokens, documents, attention, sequence)
        return sequence, offset


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), id_col: str = "doc_id") -> DataFrame:
    """Pieces with sequence_id and offset, longest first within each task.

    Pieces, not texts, are dealt over the shuffle partitions by their hash; Spark sorts
    each part by length, and a task keeps only its open sequences. Every task leaves at
    most a few sequences partly filled. A task that runs again gives the same ids.
    A piece over the capacities raises.
    """
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{n}` {dict(pieces.dtypes)[n]}" for n in names)

    def run(batches):
        fit = BestFit(capacity)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            sequences, offsets = [], []
            for length in batch.column("length").to_pylist():
                if length > capacity.tokens or length * length > capacity.attention:
                    raise ValueError(f"a piece of {length} tokens fits no sequence")
                sequence, offset = fit.place(length)
                sequences.append(first + sequence)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                [*names, "sequence_id", "offset"],
            )

    dealt = pieces.select(*names).repartition(parts, id_col, "piece", "ids_crc32")
    ordered = dealt.sortWithinPartitions(F.desc("length"), id_col, "piece", "ids_crc32")
    return ordered.mapInArrow(run, f"{schema}, sequence_id long, offset long")
