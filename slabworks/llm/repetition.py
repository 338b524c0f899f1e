"""Repetition inside a single document.

Every document gets statistics of its own: the share of its words that occurred earlier, the share in
repeated runs of four words, the share of repeated lines and its length. Boosted trees, which may only
rise with the first three, score them; the trees are flattened into node arrays and score whole batches.
They are fitted on a bounded sample, labelled by the exact measure. What they let through is measured
exactly: the share of words in runs of eight or more that occurred earlier.

Nothing is lost by the trees: a document with a share s has at least s in the word and four-run shares,
so the cut-off is the lowest score that any document with those at the threshold can get, read off the
trees. They give a score and spare most documents the exact measure; reading and hashing words, which
every document needs, is most of the work either way. Everything happens where a document is read; no
text is shuffled.

Defined results: null, blank and short texts repeat nothing; words are unbroken runs of letters, digits
and underscores in lower case; the first place of a run doesn't count, places may overlap; rows with one
doc_id give one row in p9_found if any of them repeats itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabworks.llm import trees

#: A run has so many words at least; a document counts from this share on.
RUN, SHARE = 8, 0.3
#: The classifier is fitted on about so many documents, chosen by a hash of doc_id, and on twice as many at most.
SAMPLE = 2000
FEATURES = ["word_share", "four_share", "line_share", "log_words"]
MONOTONE = np.array([1, 1, 1, 0])
_WORD = re.compile(r"\w+")
_CHUNK_WORDS = 400_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occurred earlier. A hash table filled all at once: whoever comes first has a slot; those that
    find another key there take part in the next round, with other bits of the key."""
    found = np.zeros(len(keys), dtype=bool)
    left = np.arange(len(keys))
    shift = 0
    while len(left):
        own = keys[left]
        bits = min(22, int(4 * len(left)).bit_length())  # a table of 16 MB at most, in as many rounds as it takes
        slot = ((own ^ (own >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15 + 2 * shift) >> np.uint64(64 - bits)).astype(np.int64)
        first = np.empty(1 << bits, dtype=np.int32)
        place = np.arange(len(left), dtype=np.int32)
        first[slot[::-1]] = place[::-1]
        owner = first[slot]
        same = own[owner] == own
        found[left[same & (owner != place)]] = True
        left = left[~same]
        shift += 1
    return found


def _covered(keys: np.ndarray, valid: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word run that occurred earlier; keys hold the document, so documents don't mix."""
    at = np.flatnonzero(valid)
    again = at[_again(keys[at])]
    marks = np.bincount(again, minlength=len(keys) + 1) - np.bincount(again + n, minlength=len(keys) + 1)
    return np.cumsum(marks[: len(keys)]) > 0


class Words:
    """The words of several documents as hashes, with hashes of runs of them."""

    def __init__(self, lists: list[list[str]]):
        self.size = np.array([len(w) for w in lists], dtype=np.int64)
        self.end = np.cumsum(self.size)
        h = np.fromiter(map(hash, chain.from_iterable(lists)), dtype=np.int64, count=int(self.size.sum())).view(np.uint64)
        self.distinct = np.array([len(set(w)) for w in lists], dtype=np.int64)
        doc = np.repeat(np.arange(len(lists), dtype=np.uint64), self.size)
        self.doc = doc.astype(np.int64)
        self.left = np.repeat(self.end, self.size) - np.arange(len(h))  # words from here to the document's end
        self.level = {1: (h ^ (doc * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)}
        self.level[1] ^= self.level[1] >> np.uint64(29)

    def run(self, n: int) -> np.ndarray:
        """Hashes of the n-word runs; n is a power of two. Runs over a document's end aren't valid."""
        if n not in self.level:
            half = self.run(n // 2)
            k = n // 2
            h = half.copy()
            if len(h) > k:
                h[:-k] = half[:-k] * np.uint64(0xBF58476D1CE4E5B9) + (half[k:] ^ (half[k:] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(30)
            self.level[n] = h
        return self.level[n]

    def share(self, n: int, docs: np.ndarray | None = None) -> np.ndarray:
        """Per document, the share of its words in n-word runs that occurred earlier in it."""
        if not len(self.doc):
            return np.zeros(len(self.size))
        valid = self.left >= n
        if docs is not None:
            valid &= docs[self.doc]
        hit = _covered(self.run(n), valid, n)
        return np.bincount(self.doc[hit], minlength=len(self.size)) / np.maximum(self.size, 1)


def _line_share(text: str) -> float:
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    total = sum(map(len, lines))
    return 1 - sum(map(len, set(lines))) / total if total else 0.0


def statistics(texts: list[str | None], words: Words) -> np.ndarray:
    """The features of each document."""
    word_share = 1 - words.distinct / np.maximum(words.size, 1)
    lines = np.array([_line_share(t) if t else 0.0 for t in texts])
    return np.stack([np.where(words.size > 0, word_share, 0.0), words.share(4), lines, np.log1p(words.size)], axis=1)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None], Words]]:
    """(first row, texts, words) of parts of a batch with a bounded number of words (one longer text is a part)."""
    first, texts, lists, n = 0, [], [], 0
    column = batch.column(1)
    for i in range(batch.num_rows):
        t = column[i].as_py()
        texts.append(t)
        lists.append(words_of(t))
        n += len(lists[-1])
        if n >= _CHUNK_WORDS or i == batch.num_rows - 1:
            yield first, texts, Words(lists)
            first, texts, lists, n = i + 1, [], [], 0


def fit_forest(documents: DataFrame, sample: int = SAMPLE, run: int = RUN, share: float = SHARE) -> tuple[trees.Forest, float]:
    """The trees and the cut-off that loses nothing, from a bounded sample of which only statistics reach the driver.

    The rate of the hash comes from the number of rows, which file footers tell.
    """
    rate = min(1.0, sample / max(1, documents.count()))
    names = [*FEATURES, "share"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts, words in _chunks(batch):
                got = np.concatenate([statistics(texts, words), words.share(run)[:, None]], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, j]) for j in range(got.shape[1])], names=names)

    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(np.ceil(rate * (1 << 30)))
    part = documents.where(F.col("text").isNotNull() & chosen).select("doc_id", "text")
    rows = part.mapInArrow(measure, ", ".join(f"{x} double" for x in names)).limit(2 * sample).toPandas()
    x, y = rows[FEATURES].to_numpy(dtype=float).reshape(-1, len(FEATURES)), (rows["share"].to_numpy(dtype=float) >= share).astype(float)
    forest = trees.fit(x, y, MONOTONE)
    low = np.array([share, share, 0.0, 0.0]) - 1e-9
    return forest, forest.lowest(low, np.array([1.0, 1.0, 1.0, np.inf]))


def repeated_shares(documents: DataFrame) -> DataFrame:
    """The measures of every document: n_words, repeated_share (runs of eight), word, four-run and line shares."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, words in _chunks(batch):
                s = statistics(texts, words)
                cols = [words.size, words.share(RUN), s[:, 0], s[:, 1], s[:, 2]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *[pa.array(c) for c in cols]], names=["doc_id", "n_words", "repeated_share", *FEATURES[:3]])

    schema = "doc_id bigint, n_words bigint, repeated_share double, " + ", ".join(f"{x} double" for x in FEATURES[:3])
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(measure, schema)


def repetitive(documents: DataFrame, share: float = SHARE, run: int = RUN, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, repeated_share) of documents whose share is reached: trees first, then the exact measure."""
    forest, cut = fit_forest(documents, sample, run, share)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, words in _chunks(batch):
                score = forest.score(statistics(texts, words))
                suspects = (score >= cut - 1e-9) & (words.size >= run)
                if not suspects.any():
                    continue
                exact = words.share(run, suspects)
                found = np.flatnonzero(suspects & (exact >= share - 1e-12))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + found)), pa.array(score[found]), pa.array(exact[found])], names=["doc_id", "score", "repeated_share"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(judge, "doc_id bigint, score double, repeated_share double")
