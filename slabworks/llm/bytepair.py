"""Encoding of a corpus with a public byte-level BPE vocabulary, in linear time.

A text is cut into pieces as the vocabulary's pre-tokenizer does. A piece is mapped to Latin-1 (a
character per byte) and run through an Aho-Corasick automaton of all tokens, which tells the longest
token at each place. From left to right the longest token is taken that is compatible with the token
before it, that is, if encoding the two together would give just these two; a place from which no token
leads on is marked and left by stepping back, so each place is given up at most once. Compatibility of
neighbours is decided from the merge table alone and memoised. The result is exactly that of applying
the merges in order.

Defined results: null and empty texts have no ids; strings that look like special tokens are ordinary
text; lone surrogates can't occur in Spark strings; texts may be of any length.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are, unless a caller names another place.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Pieces longer than this are encoded anew each time; so many shorter ones are remembered per worker.
REMEMBERED_LENGTH, REMEMBERED = 48, 250_000
#: What white space is to the pre-tokenizer (Unicode White_Space).
_WHITE = "\t-\r \x85\xa0  -     　"


def _class_of(letter: str) -> str:
    """A character class of all characters whose general category starts with the letter."""
    spans, start = [], None
    for cp in range(sys.maxunicode + 2):
        is_in = cp <= sys.maxunicode and unicodedata.category(chr(cp))[0] == letter
        if is_in and start is None:
            start = cp
        elif not is_in and start is not None:
            spans.append((start, cp - 1))
            start = None
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def piece_pattern() -> re.Pattern:
    """The pre-tokenizer's pattern with its Unicode classes written out."""
    letters, numbers = _class_of("L"), _class_of("N")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{_WHITE}{letters}{numbers}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


#: The same for ASCII texts, where a class is a bitmap: several times as fast.
ASCII_PIECES = re.compile(r" ?(?:[A-Za-z]+|[0-9]+|(?<! )'(?:[stmd]|re|ve|ll)|[^\t-\r A-Za-z0-9]+)|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]")


def byte_of_char() -> dict[str, int]:
    """The byte each character of a vocabulary file stands for: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder(dict):
    """Piece -> its ids as bytes of int32; what isn't known yet is encoded."""

    def __init__(self, path: str):
        super().__init__()
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = byte_of_char()
        latin = lambda token: "".join(chr(to_byte[c]) for c in token)
        self.ids = {latin(t): i for t, i in model["vocab"].items() if all(c in to_byte for c in t)}
        self.length = {i: len(t) for t, i in self.ids.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b = latin(a), latin(b)
            whole = self.ids[a + b]
            self.pair.setdefault((self.ids[a], self.ids[b]), whole)
            self.halves.setdefault(whole, (self.ids[a], self.ids[b]))
        self.shorter = {i: next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1) for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.pattern = piece_pattern()

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between two tokens alone.

        The merges that made the tokens are undone from the last back to the first, on whichever side
        of the border the later one was; a merge across the border that would have come before the one
        just undone breaks the pair. (A token's id is the rank of its merge; of equal ranks the one
        farther left comes first.)
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, bound = left, right, sys.maxsize
        while True:
            across = self.pair.get((a, b))
            if across is not None and across < bound:
                result = False
                break
            a_parts, b_parts = self.halves.get(a), self.halves.get(b)
            if a_parts is None and b_parts is None:
                result = True
                break
            # a was merged after b if its rank is higher; a byte was never merged
            if b_parts is None or (a_parts is not None and a > b):
                bound, a = a, a_parts[1]
            else:
                bound, b = b + 1, b_parts[0]
        if len(self.fits) > 400_000:
            self.fits.clear()
        self.fits[left, right] = result
        return result

    def encode_piece(self, piece: str) -> list[int]:
        text = piece.encode("utf-8").decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest, reach = [-1] * n, [0] * n
        for end, (size, token) in self.automaton.iter(text):
            at = end - size + 1
            if size > reach[at]:
                reach[at], longest[at] = size, token
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        length, shorter, compatible = self.length, self.shorter, self.compatible
        while pos < n:
            if token >= 0:
                end = pos + length[token]
                if open_[end] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    pos = end
                    token = longest[pos] if pos < n else -1
                else:
                    token = shorter[token]
            else:  # no token leads on from here: give the place up
                open_[pos] = 0
                token = out.pop()
                pos -= length[token]
        return out

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode_piece(piece), dtype=np.int32).tobytes()
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as bytes of int32."""
        if text.isascii():
            return self._plain(text)
        # no piece goes from a visible character over a line break, so the text may be cut there
        out, held, lead = [], [], ""
        for line in text.split("\n"):
            if held and held[-1] and not held[-1][-1].isspace():
                out.append(self._plain(lead + "\n".join(held)))
                held, lead = [line], "\n"
            else:
                held.append(line)
        out.append(self._plain(lead + "\n".join(held)))
        return b"".join(out)

    def _plain(self, part: str) -> bytes:
        return b"".join(map(self.__getitem__, (ASCII_PIECES if part.isascii() else self.pattern).findall(part)))


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    kept = sys.modules.setdefault("_slabworks_kept", types.ModuleType("_slabworks_kept"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.json")


#: Texts of so many characters at most go into one batch of results (one longer text is a batch).
_BATCH_CHARS = 4_000_000


def encode_corpus(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every document: map only, no shuffle."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            first, held, size = 0, [], 0
            n = batch.num_rows
            for i in range(n):
                t = batch.column(1)[i].as_py()
                held.append(enc.encode(t) if t else b"")
                size += len(t) if t else 0
                if size >= _BATCH_CHARS or i == n - 1:
                    counts = np.array([len(x) // 4 for x in held], dtype=np.int64)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    values = pa.array(np.frombuffer(b"".join(held), dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.ListArray.from_arrays(offsets, values)], names=[key, "ids"])
                    first, held, size = i + 1, [], 0

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], path: str | None = None, text: str = "text") -> DataFrame:
    """The columns to keep and n_tokens of every document; the ids themselves never leave the worker."""
    path = path or vocabulary()
    schema = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts = [len(enc.encode(t)) // 4 if t else 0 for t in (x.as_py() for x in batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return documents.select(*keep, F.col(text).alias("text")).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(doc_id, text) from the ids: the tokens' bytes behind each other."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t.encode("latin-1") for t, i in encoder(path).ids.items()}
        for batch in batches:
            texts = [b"".join(map(token.__getitem__, ids or ())).decode("utf-8") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")
