"""Hashes of all words of many texts at once, for the operators that work on words and shingles.

A word's hash is the difference of two prefix sums of (byte code x base^position), moved back to position
zero by the inverse power: the same 64 bits wherever the word stands, without a Python step per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

SEGMENT = 1 << 20  # bytes hashed at once
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_codes = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def byte_table(blank: bytes = b"") -> bytes:
    """Translation table: A-Z to a-z; ASCII white space and the ``blank`` bytes to a space."""
    table = bytearray(range(256))
    for b in range(65, 91):
        table[b] = b + 32
    for b in b"\x09\x0a\x0b\x0c\x0d" + blank:
        table[b] = 32
    return bytes(table)


PLAIN = byte_table()
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
LETTERS = byte_table(PUNCTUATION)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


def _hash_buffer(data: bytes, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of a buffer that ends in white space."""
    a = np.frombuffer(data.translate(table), np.uint8)
    inside = np.empty(len(a) + 1, bool)
    inside[0] = False
    np.not_equal(a, 32, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return span_hashes(a, edges[::2], edges[1::2]), edges[::2]


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes a[start:end]."""
    up, down = _power(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_codes[a] * up[: len(a)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def _pieces(data: bytes) -> Iterator[bytes]:
    """Cut a long text at white space into pieces of about SEGMENT bytes."""
    at = 0
    while len(data) - at > SEGMENT:
        end = max(data.rfind(b" ", at, at + SEGMENT), data.rfind(b"\n", at, at + SEGMENT))
        if end <= at:
            ahead = [x for x in (data.find(b" ", at + SEGMENT), data.find(b"\n", at + SEGMENT)) if x >= 0]
            if not ahead:
                break
            end = min(ahead)
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: Sequence[bytes], table: bytes = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, for text i its words are bounds[i]:bounds[i+1])."""
    if len(texts) == 1 and len(texts[0]) > SEGMENT:
        parts = [_hash_buffer(p + b"\n", table)[0] for p in _pieces(texts[0])]
        words = np.concatenate(parts)
        return words, np.array([0, len(words)])
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    words, starts = _hash_buffer(b"\n".join(texts) + b"\n", table)
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return words, bounds


def groups(texts: Sequence[bytes], limit: int = SEGMENT) -> Iterator[slice]:
    """Runs of texts of about ``limit`` bytes together; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield slice(start, len(texts))


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
SPARK_BATCH, TEXT_BATCH = "67108864b", "8m"


def map_texts(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` over whole texts, in batches of a few MB: a batch is held several times over on its way.

    The batch size is a setting of the session; it is lowered from Spark's own value once and left alone if it was set.
    """
    conf = rows.sparkSession.conf
    if conf.get(BATCH) == SPARK_BATCH:
        conf.set(BATCH, TEXT_BATCH)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(whole, schema)


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order."""
    if len(words) < k:
        return words[:0]
    h = words[: len(words) - k + 1] * np.uint64(0xD6E8FEB86659FD93)
    for j in range(1, k):
        h = mixed(h + words[j : len(words) - k + 1 + j]) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(h)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


class HashTable:
    """Open addressing from 64-bit hashes to row numbers, looked up for whole arrays."""

    def __init__(self, bits: int = 16):
        self.keys, self.rows, self.count = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is absent."""
        mask = len(self.keys) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        rows = np.where(self.keys[slot] == h, self.rows[slot], -1)
        open_ = np.flatnonzero((rows < 0) & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            held = self.keys[slot[open_]]
            hit = held == h[open_]
            rows[open_[hit]] = self.rows[slot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return rows

    def add(self, h: np.ndarray) -> None:
        """Take in distinct absent hashes; their rows follow in order."""
        rows = np.arange(self.count, self.count + len(h))
        self.count += len(h)
        if 2 * self.count > len(self.keys):
            used = self.keys != 0
            h, rows = np.concatenate((self.keys[used], h)), np.concatenate((self.rows[used], rows))
            size = 1 << (4 * self.count).bit_length()
            self.keys, self.rows = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        mask = len(self.keys) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.rows[slot[won]] = h[won], rows[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, rows, slot = h[rest], rows[rest], (slot[rest] + 1) & mask
