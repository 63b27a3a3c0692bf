"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are dealt at random into groups of about ``group_bytes`` of text, so any group is a small sample
of the corpus and packs alike; groups are packed independently. In a group, whole sequences are cut off long
documents first. The rests go into bins by first-fit decreasing: a tournament tree over the bins' free room
finds the first bin that is wide enough in log(bins) steps. What then is left open is closed by dissolving
the emptiest bins into the gaps of the others, and the last rest is cut at powers of two, so no id is padding
unless ``capacity`` is below the rest.

Cases: null or empty text is the end id alone (one piece of length 1). Rows that repeat are packed each. A null
key stays null. An empty table gives an empty result. Other columns are ignored. A text of any length is one
row of a group; it is cut into pieces as needed. ``docs`` should be a read of stored data: rows are dealt by
their place in the scan, which a retried task reads again in the same order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words

CAPACITY = 4096
GROUP_BYTES = 4 << 20
CACHE_WORDS = 1 << 18


class WordEncoder:
    """Ids of whole texts, each pre-token encoded once per worker and then looked up by its hash.

    The tokenizer parts a text into runs of letters, single digits and runs of other signs, dropping white space;
    a pre-token's ids do not depend on its neighbours. Texts of ASCII and Latin-1 letters without an apostrophe
    (contractions) or a special string take this path; any other text is encoded whole.
    """

    PLAIN = re.compile("[\\x20-\\x26\\x28-\\x7e\n\t\r\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
    SPACE, LETTER, DIGIT, SIGN = range(4)

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.kinds = np.full(256, self.LETTER, np.uint8)
        self.kinds[:128] = self.SIGN
        self.kinds[[9, 10, 13, 32]] = self.SPACE
        self.kinds[48:58] = self.DIGIT
        self.kinds[97:123] = self.LETTER
        self._forget()

    def _forget(self) -> None:
        self.rows, self.ids, self.ends = words.HashTable(), np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, hashes: np.ndarray, new: list[str]) -> None:
        found, counts = [], []
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = self._ids(" ".join(some))
            cuts = np.flatnonzero(self.closes[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                each = [self._ids(w) for w in some]
                ids, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            found.append(ids)
            counts.append(np.diff(cuts, prepend=0))
        self.rows.add(hashes)
        self.ids = np.concatenate([self.ids, *found])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])

    def _plain(self, texts: list[str]) -> list[bytes]:
        data = [t.lower().encode() for t in texts]
        buffer = b" ".join(data) + b" "
        a = np.frombuffer(buffer, np.uint8)
        kinds = self.kinds[a]
        edge = np.ones(len(a), bool)
        edge[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == self.DIGIT)
        edges = np.flatnonzero(edge)
        inside = kinds[edges] != self.SPACE
        starts, ends = edges[inside], np.append(edges[1:], len(a))[inside]
        hashes = words.span_hashes(a, starts, ends)
        rows = self.rows.find(hashes)
        if len(absent := np.flatnonzero(rows < 0)):
            fresh, first = np.unique(hashes[absent], return_index=True)
            at = absent[first]
            self._learn(fresh, [buffer[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            rows = self.rows.find(hashes)
        counts = self.ends[rows + 1] - self.ends[rows]
        after = np.cumsum(counts)
        total = int(after[-1]) if len(after) else 0
        ids = self.ids[np.repeat(self.ends[rows] - (after - counts), counts) + np.arange(total)]
        last = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in data]))
        cuts = np.append(0, after)[last].tolist()
        return [ids[s:e].tobytes() + self.end for s, e in zip([0, *cuts], cuts)]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Per text its ids as little-endian uint32 bytes, the end id last."""
        if self.rows.count > CACHE_WORDS:
            self._forget()
        texts = [t or "" for t in texts]
        plain = [i for i, t in enumerate(texts) if "<|" not in t and self.PLAIN.fullmatch(t)]
        out: list[bytes | None] = [None] * len(texts)
        for some in words.groups([texts[i] for i in plain]):
            for i, ids in zip(plain[some], self._plain([texts[i] for i in plain[some]])):
                out[i] = ids
        return [self._ids(t).tobytes() + self.end if ids is None else ids for t, ids in zip(texts, out)]


class Bins:
    """Free room of bins under a tournament tree; each inner node holds the larger of its children."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, (max(1, most) - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """First bin with room for ``size``; its room shrinks."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        tree[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            room = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == room:
                break
            tree[at] = room
        return found


def pack(lengths: Sequence[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (document, start, length)."""
    full, rests = [], []
    for d, n in enumerate(lengths):
        whole = n // capacity
        full += [[(d, i * capacity, capacity)] for i in range(whole)]
        if n % capacity:
            rests.append((n % capacity, d, whole * capacity))
    rests.sort(key=lambda x: (-x[0], x[1]))
    bins, tree = [], Bins(capacity, len(rests))
    for n, d, start in rests:
        b = tree.place(n)
        if b == len(bins):
            bins.append([])
        bins[b].append((d, start, n))
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    free = [capacity - sum(p[2] for p in b) for b in bins]
    at, last = 0, len(bins) - 1
    while at < last:  # dissolve the emptiest bin into the gaps of the fullest
        if not free[at]:
            at += 1
        elif not bins[last]:
            last -= 1
        else:
            d, start, n = bins[last].pop()
            part = min(n, free[at])
            bins[at].append((d, start, part))
            free[at] -= part
            free[last] += n
            if part < n:
                bins[last].append((d, start + part, n - part))
                free[last] -= n - part
    bins = [b for b in bins if b]
    if bins and (rest := sum(p[2] for p in bins[-1])) & (rest - 1):
        tail = bins.pop()
        while rest:  # cut what is left into sequences of power-of-two lengths
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            some = []
            while room:
                d, start, n = tail.pop(0)
                part = min(n, room)
                some.append((d, start, part))
                room -= part
                if part < n:
                    tail.insert(0, (d, start + part, n - part))
            bins.append(some)
    return full + bins


def schema(key: str, kind: T.DataType) -> T.StructType:
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding")
    return T.StructType([T.StructField(key, kind)] + [T.StructField(n, T.LongType()) for n in names])


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", content: str = "text", end_id: int | None = 2,
                   capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES, seed: int = 0) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding of the sequence."""
    rows = docs.select(F.col(key).alias("_key"), F.col(content).alias("_text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 16)).first()[0] or 0
    number = max(1, -(-size // group_bytes))
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(
        F.lit(seed), F.col("_key"), F.monotonically_increasing_id()), F.lit(number)))
    out = schema(key, docs.schema[key].dataType)

    def run(group: pa.Table) -> pa.Table:
        encoder = _encoder(tokenizer, end_id)
        order = group.sort_by([("_key", "ascending")])
        ids = encoder.encode(order["_text"].to_pylist())
        base = int(group["_group"][0].as_py()) << 32
        keys, cols = order["_key"], [[] for _ in range(8)]
        for s, pieces in enumerate(pack([len(x) // 4 for x in ids], capacity)):
            used = sum(p[2] for p in pieces)
            padding = 0 if used & (used - 1) == 0 else capacity - used
            offset = 0
            for d, start, n in pieces:
                crc = zlib.crc32(memoryview(ids[d])[4 * start : 4 * (start + n)])
                for c, v in zip(cols, (d, start, n, crc, len(ids[d]) // 4, base + s, offset, padding)):
                    c.append(v)
                offset += n
        arrays = [pa.array(c, pa.int64()) for c in cols]
        return pa.table([keys.take(arrays[0])] + arrays[1:], names=[f.name for f in out])

    return dealt.groupBy("_group").applyInArrow(run, out)


_encoders: dict[tuple, WordEncoder] = {}


def _encoder(path: str, end_id: int | None) -> WordEncoder:
    """One per Python worker, so words learned for a group serve the next."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]
