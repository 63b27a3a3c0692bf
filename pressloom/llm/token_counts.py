"""Token counts that follow edits: a segment tree of pre-token counts per document, re-encoded only where touched.

A text is cut before every space that a Latin letter follows. The byte-level pattern always starts a pre-token
there, whatever stands before it, so the pieces encode independently. ``LEAF`` pieces in a row are a leaf of the
document's tree; every node holds the characters and tokens below it. An edit finds its leaves by the characters'
sums, re-encodes those leaves with the edit in place (and the leaf before, if the edit touches a leaf's first two
characters, on which its own border rests), and updates the sums on the way up. A leaf that outgrows ``8 * LEAF``
pieces makes its document's tree be laid out anew; counts of pieces are kept by hash, so nothing is encoded twice.

Edits are (key, seq, at, remove, insert): at a character offset, so many characters go and a text comes; a document's
edits apply in order of ``seq``. Offsets beyond the end mean the end. Documents and edits are dealt by key, sorted,
and streamed through the tasks, one document's tree in memory at a time.

Cases: null and empty text is an empty tree; a null ``insert`` is nothing, null or negative numbers are zero; a null
key is counted and takes no edits; edits of a missing document are ignored; of rows that repeat a key the last by
hash of its text takes the edits; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words

LEAF = 64
CACHE_PIECES = 2_000_000
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


class PieceCounter:
    """Tokens of the pieces of a text, each distinct piece encoded once per worker."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._forget()

    def _forget(self) -> None:
        self.rows, self.tokens = words.HashTable(), np.zeros(0, np.int64)

    def pieces(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, tokens) of each piece."""
        if not data:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.rows.count > CACHE_PIECES:
            self._forget()
        a = np.frombuffer(data, np.uint8)
        starts = np.append(0, np.flatnonzero((a[1:-1] == 32) & LETTER[a[2:]]) + 1)
        ends = np.append(starts[1:], len(a))
        hashes = words.span_hashes(a, starts, ends)
        rows = self.rows.find(hashes)
        if len(absent := np.flatnonzero(rows < 0)):
            fresh, first = np.unique(hashes[absent], return_index=True)
            at = absent[first]
            new = [len(self.encode(data[s:e].decode())) for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            held = self.rows.count
            self.rows.add(fresh)
            if self.rows.count > len(self.tokens):
                self.tokens = np.concatenate((self.tokens, np.zeros(max(1024, self.rows.count), np.int64)))
            self.tokens[held : self.rows.count] = new
            rows = self.rows.find(hashes)
        return starts, self.tokens[rows]


class Tree:
    """Leaves of a document's text with characters and tokens summed upwards."""

    def __init__(self, counter: PieceCounter, text: str):
        self.counter, self.encoded = counter, 0
        self._lay(text)

    def _lay(self, text: str) -> None:
        data = text.encode()
        starts, tokens = self.counter.pieces(data)
        cuts = starts[::LEAF]
        ends = [*cuts[1:].tolist(), len(data)]
        self.leaves = [data[s:e].decode() for s, e in zip(cuts.tolist(), ends)] or [""]
        sums = np.add.reduceat(tokens, np.arange(0, len(tokens), LEAF)).tolist() if len(tokens) else [0]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (leaf, n) in enumerate(zip(self.leaves, sums)):
            self.chars[self.size + i], self.tokens[self.size + i] = len(leaf), n
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) that holds offset ``at``; the end belongs to the last leaf with text."""
        at = min(at, max(0, self.chars[1] - 1))
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), before

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = self.size + leaf
        chars, tokens = len(text) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, at: int, remove: int, insert: str) -> None:
        at = min(max(0, at), self.chars[1])
        remove = min(max(0, remove), self.chars[1] - at)
        first, before = self._leaf(at)
        last = self._leaf(at + remove)[0] if remove else first
        while first and at - before < 2:
            first -= 1
            before -= len(self.leaves[first])
        text = "".join(self.leaves[first : last + 1])
        text = text[: at - before] + insert + text[at - before + remove :]
        _, tokens = self.counter.pieces(text.encode())
        self.encoded += len(text)
        self._set(first, text, int(tokens.sum()))
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "", 0)
        if len(tokens) > 8 * LEAF:
            self._lay("".join(self.leaves))


_counters: dict[tuple[str, str], PieceCounter] = {}


def _counter(path: str, pattern: str) -> PieceCounter:
    """One per Python worker, so pieces counted for a task serve the next."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = PieceCounter(path, pattern)
    return _counters[path, pattern]


COUNTS = ("tokens_before", "tokens_after", "n_edits", "chars_after", "reencoded_chars")


def count(docs: DataFrame, edits: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", content: str = "text") -> DataFrame:
    """One row per document: key, tokens_before, tokens_after, n_edits, chars_after, reencoded_chars."""
    none = F.lit(None)
    texts = docs.select(F.col(key).alias("_key"), F.lit(0).alias("_kind"), F.xxhash64(content).alias("_seq"), F.col(content).alias("_text"),
                        none.cast("long").alias("_at"), none.cast("long").alias("_remove"))
    changes = edits.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.lit(1).alias("_kind"), F.col("seq").cast("long").alias("_seq"), F.col("insert").alias("_text"),
        F.col("at").cast("long").alias("_at"), F.col("remove").cast("long").alias("_remove"))
    stream = texts.unionByName(changes).repartition("_key").sortWithinPartitions("_key", "_kind", "_seq")
    out = T.StructType([T.StructField("_key", docs.schema[key].dataType)] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks_path, pattern)
        tree, before, number, holder = None, 0, 0, None
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                done, rows = [], []
                columns = (batch.column(c).to_pylist() for c in ("_key", "_kind", "_text", "_at", "_remove"))
                for key_, kind, text, at, remove in zip(*columns):
                    if kind == 0:
                        if tree is not None:
                            done.append(holder)
                            rows.append((before, tree.tokens[1], number, tree.chars[1], tree.encoded))
                        tree, holder, number = Tree(counter, text or ""), key_, 0
                        before = tree.tokens[1]
                    elif tree is not None and key_ == holder:
                        tree.edit(at or 0, remove or 0, text or "")
                        number += 1
                yield _counts(done, rows, out, whole.schema.field("_key").type)
        if tree is not None:
            yield _counts([holder], [(before, tree.tokens[1], number, tree.chars[1], tree.encoded)], out, whole.schema.field("_key").type)

    return stream.mapInArrow(run, out).withColumnRenamed("_key", key)


def _counts(keys: list, rows: list[tuple], out: T.StructType, kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(COUNTS)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind)] + [pa.array(c, pa.int64()) for c in columns], names=out.names)
