"""Harmonic packing of documents into training sequences of at most ``CAPACITY`` tokens.

Full sequences are cut off a document first.  What is left, of ``r`` tokens, has
the reciprocal class ``k`` with ``C / (k + 1) < r <= C / k``, and a bin of class
``k`` holds ``k`` pieces and no others.  A rest that all but fills its slot, by
``WASTE`` of it, goes there whole.  Any other is cut: a slot of class ``k + 1``
is filled to its end and the remainder, under ``C / (k (k + 1))``, is classed
anew, so a few cuts are enough and what is lost in a bin is at most ``WASTE`` of
it.  From class ``1 / WASTE`` on every rest goes whole.  A bin's slots end at
``C (i + 1) / k``, so a cut also takes up what earlier pieces left.

Each worker fills its own bins, one open bin a class, and no row moves between
workers.  The pieces of bins still open at its end are laid end to end, into
full sequences and one last run, written as powers of two, which need no
padding.  Every token lies in exactly one piece.

Tokens are the tokenizer's ids and then id ``END`` for each document.  A null
text is empty and has ``END`` alone; an empty table gives no rows; repeated rows
are packed as often as they come.  ``sequence_id`` is the partition's number and
a running number in it, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm.common import frugal

CAPACITY = 2048
END = 1
#: Part of a slot that a piece may leave empty.
WASTE = 1 / 32
#: Distinct words whose ids a worker remembers, from one task to the next.
REMEMBERED = 800_000
#: A mark of punctuation right after a letter of Latin-1: the tokenizer's pieces end there, so a space changes nothing.
_AFTER_LETTER = re.compile(rb"[!-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


#: What a tokenizer file must say for its texts to be taken word by word, in lower case.
WORD_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordCache:
    """Ids of texts, word by word: the tokenizer drops white space, never looks across it and
    lower-cases, so ``The,`` has the ids of ``the`` and ``,``.  That holds for tokenizers of the
    form ``WORD_BY_WORD``; a text goes whole to any other."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.whole = any(told[x] != WORD_BY_WORD[x] for x in WORD_BY_WORD) or any(not t["content"].startswith("<|") or t["normalized"] for t in told["added_tokens"])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.used = 0

    def ids_of(self, words: list[bytes]) -> list[list[int]]:
        """Latin words go straight to the tokenizer's model: for lower-case letters in composed form
        nothing comes before it but the spelling of bytes as characters."""
        out: list[list[int]] = []
        others: list[int] = []
        tokenize = self.tokenizer.model.tokenize
        for i, word in enumerate(words):
            if word.isalpha():  # ASCII letters, in lower case unless a special token may lie near
                text = word.lower().decode()
            else:
                text = word.decode()
                if text.isalpha() and max(text) < "\u0250" and is_normalized("NFC", text):
                    text = "".join([_SPELLING[b] for b in text.lower().encode()]) if max(text) <= "\xff" or text == text.lower() else ""
                else:
                    text = ""
            out.append([t.id for t in tokenize(text)] if text else [])
            if not text:
                others.append(i)
        found = self.tokenizer.encode_batch_fast([words[i].decode() for i in others], add_special_tokens=False)
        for i, e in zip(others, found, strict=True):
            out[i] = e.ids
        return out

    def learn(self, words: list[bytes]) -> None:
        encoded = self.ids_of(words)
        lengths = np.array([len(x) for x in encoded], np.int64)
        flat = np.array([i for x in encoded for i in x], np.uint32)
        n, first = len(words), len(self.index)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + n > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + n] = lengths
        self.used += len(flat)
        self.index.update(zip(words, range(first, first + n), strict=True))

    def encode(self, text: str) -> np.ndarray:
        if self.whole:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        data = text.encode()
        if b"<|" not in data:  # special tokens are as they are written
            data = _AFTER_LETTER.sub(rb" \g<0>", data.lower())
        words = data.split()  # at ASCII white space; the tokenizer sees to any other
        if not words:
            return np.zeros(0, np.uint32)
        at = list(map(self.index.get, words))
        if None in at:
            if len(self.index) > REMEMBERED:
                self.clear()
            self.learn([w for w in dict.fromkeys(words) if w not in self.index])
            at = list(map(self.index.get, words))
        at = np.array(at)
        lengths = self.length[at]
        total = int(lengths.sum())
        first = np.repeat(self.start[at] - (np.cumsum(lengths) - lengths), lengths)
        return self.ids[first + np.arange(total)]


def _spelling() -> list[str]:
    """How byte-level vocabularies write each byte: visible ones as themselves, the others from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


_SPELLING = _spelling()
_caches: dict[str, WordCache] = {}


def cached(path: str) -> WordCache:
    """This worker's cache for a tokenizer file."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


class Bins:
    """One worker's open bins, one for each class: pieces ``(doc_id, start, ids, doc_tokens)``."""

    def __init__(self, capacity: int, first: int, waste: float = WASTE) -> None:
        self.capacity, self.next, self.waste = capacity, first, waste
        self.open: dict[int, list] = {}
        self.filled: dict[int, int] = {}

    def put(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Rows of the sequences that this document completes."""
        start, n = 0, len(ids)
        for start in range(0, n - self.capacity + 1, self.capacity):
            yield from self.close([(doc_id, start, ids[start : start + self.capacity], n)])
        start = n - n % self.capacity
        while start < n:
            left = n - start
            k = self.capacity // left
            if self.capacity - k * left > self.waste * self.capacity:  # cut for a slot of the next class
                k += 1
                left = min(left, self.capacity * (len(self.open.get(k, ())) + 1) // k - self.filled.get(k, 0))
            held = self.open.setdefault(k, [])
            held.append((doc_id, start, ids[start : start + left].copy(), n))  # not a view, which keeps the whole text's ids
            self.filled[k] = self.filled.get(k, 0) + left
            if len(held) == k:
                yield from self.close(held)
                self.open[k], self.filled[k] = [], 0
            start += left

    def close(self, held: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, n in held:
            body = ids.tobytes()
            yield doc_id, start, len(ids), zlib.crc32(body), n, self.next, at, body
            at += len(ids)
        self.next += 1

    def rest(self) -> Iterator[tuple]:
        """What the open bins hold, as full sequences and then powers of two."""
        pieces = [x for k in sorted(self.open) for x in self.open[k]]
        total = sum(len(x[2]) for x in pieces)
        tail = total % self.capacity
        sizes = [self.capacity] * (total // self.capacity) + [1 << c for c in range(tail.bit_length() - 1, -1, -1) if tail >> c & 1]
        held: list[tuple] = []
        room = sizes.pop(0) if sizes else 0
        for doc_id, start, ids, n in pieces:
            while len(ids):
                held.append((doc_id, start, ids[:room], n))
                start, room, ids = start + len(held[-1][2]), room - len(held[-1][2]), ids[room:]
                if not room:
                    yield from self.close(held)
                    held, room = [], sizes.pop(0) if sizes else 0
        self.open, self.filled = {}, {}


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    *numbers, bodies = zip(*rows, strict=True)
    columns = [pa.array(x, pa.int64()) for x in numbers]
    return pa.RecordBatch.from_arrays([*columns, pa.array(bodies if with_ids else [None] * len(rows), pa.binary())], names=names)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row for each piece; ``ids`` are its tokens as little-endian unsigned 32-bit numbers
    (null unless ``with_ids``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cached(path)
        context = TaskContext.get()
        bins = Bins(capacity, (context.partitionId() if context else 0) << 40)
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(words.encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                out += bins.put(doc_id, ids)
                size += 4 * len(ids)
                if len(out) > 20_000 or (with_ids and size > 8_000_000 and out):
                    yield _batch(out, with_ids)
                    out, size = [], 0
        out += bins.rest()
        if out:
            yield _batch(out, with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), PIECES)
