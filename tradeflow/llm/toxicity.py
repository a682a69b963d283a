"""Toxicity by compression distance: which class's dictionary shortens a window more."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fitting import SAMPLE_ROWS, Logistic, fit_logistic, held_out, labelled_ids, sample_rows
from .texts import annotate, text_as_string

#: A window is one word between blanks, written TILES times: long enough to be compressed,
#: and what its dictionary does not know costs literals once. Bytes of a dictionary, and
#: characters of the pieces by which telling passages are found.
TILES = 4
DICTIONARY_BYTES = 4096
PIECE = 5
#: Words whose lengths a task remembers.
_REMEMBERED = 200_000
#: A piece tells a class if it is PURE times more frequent in its texts, and if chance
#: would make it so uneven in one piece of e^EVIDENCE at most.
PURE = 20.0
EVIDENCE = 15.0
#: Differences in bytes that are told apart; beyond them the ends count.
_LEAST, _MOST = -3, 12


def _pieces(text: str) -> set[str]:
    found = set()
    for word in set(text.lower().split()):
        word = f" {word} "
        found.update(word[k : k + PIECE] for k in range(len(word) - PIECE + 1))
    return found


def _telling(own: Counter, n_own: int, other: Counter, n_other: int) -> set[str]:
    """Pieces in clearly more texts of one class than chance explains, by a binomial bound."""
    share, found = n_own / (n_own + n_other), set()
    for piece, count in own.items():
        theirs = other[piece]
        if count / n_own > PURE * theirs / n_other:
            bound = count * log(count / ((count + theirs) * share))
            if theirs:
                bound += theirs * log(theirs / ((count + theirs) * (1 - share)))
            if bound > EVIDENCE:
                found.add(piece)
    return found


def _passages(texts: list[str], telling: set[str]) -> Counter:
    """Runs of characters within words that telling pieces cover; whole words if there are none."""
    found: Counter = Counter()
    for text in texts:
        for word in text.lower().split():
            word = f" {word} "
            if not telling:
                found[word] += 1
                continue
            end = start = -1
            for k in range(len(word) - PIECE + 1):
                if word[k : k + PIECE] in telling:
                    if k > end:
                        if end > 0:
                            found[word[start:end]] += 1
                        start = k
                    end = k + PIECE
            if end > 0:
                found[word[start:end]] += 1
    return found


def _dictionary(passages: Counter) -> bytes:
    """A dictionary trained on passages; where there are too few to train on, they are it.

    Passages take turns in the training text, as each stretch of it gives the
    dictionary one segment.
    """
    frequent = sorted(passages.items(), key=lambda item: (-item[1], item[0]))[:5_000]
    samples = [
        passage.encode() for turn in range(40) for passage, count in frequent if count > turn
    ]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=16, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        trained = b""
    room = DICTIONARY_BYTES - len(trained)
    missing = [p.encode() for p, _ in frequent if p.strip().encode() not in trained]
    return b"".join(reversed(missing))[-room:] + trained if room > 0 else trained


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_DFAST,
        min_match=5,
        window_log=12,
        hash_log=12,
        chain_log=12,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
    )
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=settings)
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=settings)


class Distance:
    """Compresses every window of a text with both dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.known: dict[str, int] = {}

    def shorter(self, word: str) -> int:
        """How many bytes shorter the window is with the toxic dictionary, within the ends."""
        window = f" {word} ".encode() * TILES
        saved = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        return min(_MOST, max(_LEAST, saved))

    def windows(self, text: str | None) -> np.ndarray:
        """How many windows were so many bytes shorter with the toxic dictionary, by that number."""
        counts = [0] * (_MOST - _LEAST + 1)
        known = self.known
        for word, times in Counter((text or "").lower().split()).items():
            saved = known.get(word)
            if saved is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                saved = known[word] = self.shorter(word)
            counts[saved - _LEAST] += times
        return np.array(counts, float)


def _features(counts: np.ndarray, threshold: int) -> np.ndarray:
    """Of window counts: how far and how often windows pass the threshold."""
    counts = np.atleast_2d(counts)
    steps = np.arange(_LEAST, _MOST + 1)
    total = counts.sum(1)
    reached = np.cumsum(counts[:, ::-1], 1)[:, ::-1]
    over = reached[:, threshold - _LEAST]
    largest = np.where(counts > 0, steps, 0).max(1)
    near = [np.log1p(reached[:, threshold + k - _LEAST]) for k in (0, 1, 2)]
    return np.stack([*near, over > 1, over / (total + 8), largest, np.log1p(total)], 1)


@dataclass
class ToxicityModel:
    """Two dictionaries, the window threshold and the weights of the final score."""

    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: Logistic

    def score(self, counts: np.ndarray) -> np.ndarray:
        return self.weights.scores(_features(counts, self.threshold))


def fit_texts(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """Trains both dictionaries, then calibrates the window threshold and the score.

    Dictionaries hold what tells the classes apart: passages whose pieces are in clearly
    more texts of one class, or ordinary words where the class has none. The threshold
    is the difference in bytes that separates the labels best.
    """
    counts = []
    for texts in (toxic, ordinary):
        counted: Counter = Counter()
        for text in texts:
            counted.update(_pieces(text))
        counts.append(counted)
    sizes = max(1, len(toxic)), max(1, len(ordinary))
    telling = (
        _telling(counts[0], sizes[0], counts[1], sizes[1]),
        _telling(counts[1], sizes[1], counts[0], sizes[0]),
    )
    dictionaries = [
        _dictionary(_passages(texts, pieces))
        for texts, pieces in zip((toxic, ordinary), telling, strict=True)
    ]
    distance = Distance(*dictionaries)
    seen = np.array([distance.windows(text) for text in [*toxic, *ordinary]]).reshape(-1, _MOST - _LEAST + 1)
    labels = np.array([1] * len(toxic) + [0] * len(ordinary))
    best = None
    for threshold in range(1, 9):
        weights = fit_logistic(_features(seen, threshold), labels)
        wrong = ((weights.scores(_features(seen, threshold)) >= 0.5) != labels).mean() if len(labels) else 0
        if best is None or wrong < best[0]:
            best = wrong, threshold, weights
    return ToxicityModel(*dictionaries, best[1], best[2])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS
) -> ToxicityModel:
    """A model of at most `rows` labelled texts of each class that are not held out.

    Null labels and ids, and texts over SAMPLE_TEXT_BYTES, are not learnt from; copies
    count once. Without any label of a class, scores are the share of the other.
    """
    ids = labelled_ids(labels, "toxic", id_col, rows)
    found = sample_rows(text_as_string(docs, text_col), ids, [text_col], id_col, text_col)
    by_label = [[row[text_col] or "" for row in found if row["label"] == k] for k in (1, 0)]
    return fit_texts(*by_label)


def score(
    docs: DataFrame,
    model: ToxicityModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """docs with score (0 to 1) and predicted (1: toxic); columns of these names are replaced.

    Every window of every whole text is compressed twice; only the text counts. Rows
    are judged alone, without a shuffle; null and empty texts have no windows and get
    the score of that.
    """

    def run(batch, distance):
        counts = [distance.windows(text) for text in batch.column(text_col).to_pylist()]
        if not counts:
            return [pa.array([], pa.float64()), pa.array([], pa.int32())]
        scores = model.score(np.array(counts))
        return [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]

    wanted = docs if keep is None else docs.select(*dict.fromkeys([*keep, text_col]))
    return annotate(
        text_as_string(wanted, text_col),
        {"score": "double", "predicted": "int"},
        run,
        keep,
        lambda: Distance(model.toxic, model.ordinary),
    )


def with_held_out(scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scored.withColumn("held_out", held_out(id_col)).select(
        id_col, "held_out", *[F.col(c) for c in scored.columns if c not in (id_col, "held_out")]
    )
