"""Token counts of byte-level BPE by merging lowest-rank pairs from a heap over a linked list.

A text is cut at the added tokens of the vocabulary file (each occurrence is one token),
the pieces between are split by the file's pre-tokenizing pattern, and each part's bytes
become one symbol each. Merging then pops the adjacent pair of lowest rank (leftmost among
equal ranks) from a heap, joins the two symbols in a doubly linked list and pushes the new
pairs with both neighbours; entries that no longer match the list are skipped. A part's
count is its bytes minus the merges done; no token ids are written out.

Counts of parts are kept per task in a dictionary, as frequent words repeat; it is emptied
when it grows past ``CACHE_WORDS`` entries, which changes no count.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import annotate

#: The vocabulary file and the token limit of the query's contract.
VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Parts whose counts a task remembers before it starts afresh.
CACHE_WORDS = 200_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level BPE writes for each byte value.

    Bytes that print as themselves in Latin-1 keep their character; the others take
    the characters from U+0100 on, in byte order.
    """
    keep = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    kept = set(keep)
    out, extra = [], 0
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class ByteBpe:
    """Counts tokens of texts as a byte-level BPE vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        model = spec["model"]
        if model.get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is not a byte-level BPE vocabulary")
        vocab: dict[str, int] = model["vocab"]
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        if len(vocab) >= 1 << 20:
            raise ValueError("ids of 20 bits at most are supported")
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
        self.prefix_space = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pattern = regex.compile(
            r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        )
        self.cache: dict[str, int] = {}

    def count_part(self, part: str) -> int:
        """Symbols left of one pre-token after all merges."""
        known = self.cache.get(part)
        if known is not None:
            return known
        symbols = self.first[np.frombuffer(part.encode("utf-8"), np.uint8)].tolist()
        count = len(symbols) - self.merge_count(symbols)
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[part] = count
        return count

    def merge_count(self, symbols: list[int]) -> int:
        """Merges done on symbols by lowest rank first, leftmost among equal ranks.

        A pair (a, b) is looked up as the one number a * 2**20 + b.
        """
        n = len(symbols)
        if n < 2:
            return 0
        merges = self.merges
        if n == 2:
            return 1 if (symbols[0] << 20 | symbols[1]) in merges else 0
        after = list(range(1, n + 1))
        after[-1] = -1
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << 20 | symbols[i + 1])
            if found is not None:
                heap.append((found[0], i))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        done = 0
        while heap:
            rank, i = pop(heap)
            j = after[i]
            if j < 0 or symbols[i] < 0:
                continue
            found = merges.get(symbols[i] << 20 | symbols[j])
            if found is None or found[0] != rank:
                continue
            merged = symbols[i] = found[1]
            symbols[j] = -1
            k = after[i] = after[j]
            done += 1
            if k >= 0:
                before[k] = i
                right = merges.get(merged << 20 | symbols[k])
                if right is not None:
                    push(heap, (right[0], i))
            h = before[i]
            if h >= 0:
                left = merges.get(symbols[h] << 20 | merged)
                if left is not None:
                    push(heap, (left[0], h))
        return done

    def count_plain(self, text: str) -> int:
        if not text:
            return 0
        if self.prefix_space and not text.startswith(" "):
            text = " " + text
        cache, total = self.cache, 0
        for part in self.pattern.findall(text):
            known = cache.get(part)
            total += known if known is not None else self.count_part(part)
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a text; an added token's string inside it counts as one token; null: 0."""
        if not text:
            return 0
        if self.added is None:
            return self.count_plain(text)
        total, start = 0, 0
        for hit in self.added.finditer(text):
            total += self.count_plain(text[start : hit.start()]) + 1
            start = hit.end()
        return total + self.count_plain(text[start:])

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        return [self.count(t) for t in texts]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(
    docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = LIMIT, keep=None
) -> DataFrame:
    """docs with n_bytes (UTF-8 bytes of the text), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Texts are counted whole, however long.
    Repeated rows are counted each. A column of docs named like a result gives way to it.
    `keep` names the columns of docs to carry, all by default.
    """
    where = path or vocabulary_path()

    def tokens(batch: pa.RecordBatch, model: ByteBpe) -> list[pa.Array]:
        return [pa.array(model.counts(batch.column(text_col).to_pylist()), pa.int64())]

    keep_cols = None if keep is None else [*keep, text_col]
    counted = annotate(docs, {"n_tokens": "bigint"}, tokens, keep=keep_cols, setup=lambda: ByteBpe(where))
    counted = counted.withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint"))
    columns = [c for c in counted.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    if keep is not None:
        columns = [c for c in columns if c in set(keep)]
    return counted.select(*columns, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
