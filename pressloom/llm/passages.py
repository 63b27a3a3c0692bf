"""Repeated passages by collinear chaining of shared word k-mers.

Every text is sampled by minimizers: of any ``window`` word k-mers in a row the one of least hash is a seed, so two
texts that share ``k + window - 1`` words in a row share a seed. A seed's first occurrence (least key, then place)
stands for all: every other occurrence is matched with it, so a passage found in a third of all documents makes one
match each and no pairs. A passage whose parts occur first in several places would be cut by that into pieces, so each
repeated seed and the next one ``min_span`` to ``min_words`` words behind it, where the two do not occur first near each
other in one text, are a seed of their own, matched with the first text that holds both. What can still be missed is a
passage of which every such two were held together before, by texts that do not share enough of it, or were parted by
edits in every place where the sources change. Matches of a document with one earlier document are merged along diagonals and chained:
among matches in order in both texts, the chain with the best sum of matched words less a gap cost per word skipped,
each step at most ``max_gap`` words in either text: a range maximum in a tree that matches leave once they are too far behind. A chain is then aligned: the words between its matches by longest
common subsequence, its ends by extension over small edits. What is at least ``min_words`` long and ``min_identity``
alike is reported as a repeat of the earlier passage.

Words are compared without case and punctuation. Only documents with enough matches with one another have their words
read again. Cases: null, empty and short texts have no passages; rows that repeat a key are one document (the one of
greatest text hash); a null key is left out; repeats within a document are not reported; a text of any length is read
whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.scale import lookup_join, salted_join
from ..session import materialise, scratch
from . import words

K, WINDOW = 4, 6
MIN_WORDS, MIN_IDENTITY = 50, 0.6
MIN_SPAN = 20
MAX_GAP = 40
GAP_COST = 0.1


def minimizers(hashes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place) of a text's words."""
    grams = words.ngrams(hashes, k)
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, min(window, len(grams)))
    at = np.unique(views.argmin(1) + np.arange(len(views)))
    return grams[at], at


def seeds(docs: DataFrame, k: int, window: int) -> DataFrame:
    """(seed, key, at) of every row of (key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = words.texts_of(batch.column("text"))
            for some in words.groups(texts):
                hashes, bounds = words.word_hashes(texts[some], words.LETTERS)
                found, places, rows = [], [], []
                for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), some.start):
                    seed, at = minimizers(hashes[s:e], k, window)
                    found.append(seed)
                    places.append(at)
                    rows.append(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), batch.column("key").take(pa.array(np.concatenate(rows))),
                     pa.array(np.concatenate(places).astype(np.int32))], names=["seed", "key", "at"])

    return words.map_texts(docs, run, T.StructType([T.StructField("seed", T.LongType()), docs.schema["key"], T.StructField("at", T.IntegerType())]))


def seams(met: DataFrame, least: int, most: int) -> DataFrame:
    """(seed of two, key, at, end) of every repeated seed of a text with the next one ``least`` to ``most`` words behind it,
    if their first occurrences are not near each other in one text, which is the same for all texts that hold the two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_m")
            bounds, flat = lists.offsets.to_numpy(), lists.values
            at, seed, source_at = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("at", "seed", "source_at"))
            source = flat.field("source").dictionary_encode().indices.to_numpy()
            text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            at, seed, source_at, source = (x[bounds[0] : bounds[-1]].astype(np.int64) for x in (at, seed, source_at, source))
            order = np.lexsort((at, text))
            at, seed, source_at, source, text = (x[order] for x in (at, seed, source_at, source, text))
            # the first seed far enough behind each seed, in the same text
            width = int(at.max(initial=0)) + most + 2
            line = text * width + at
            i = np.arange(len(at))
            j = np.searchsorted(line, line + least)
            i, j = i[j < len(at)], j[j < len(at)]
            apart = source_at[j] - source_at[i]
            found = (text[i] == text[j]) & (at[j] - at[i] <= most) & ((source[i] != source[j]) | (apart <= 0) | (apart > most + MAX_GAP))
            i, j = i[found], j[found]
            both = words.ngrams(np.stack((seed[i], seed[j]), 1).reshape(-1).view(np.uint64), 2)[::2]
            whole = [text[i], both, at[i], at[j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole[1].view(np.int64)), batch.column("key").take(pa.array(whole[0].astype(np.int64))),
                 pa.array(whole[2].astype(np.int32)), pa.array(whole[3].astype(np.int32))], names=["seed", "key", "at", "end"])

    lists = met.groupBy("key").agg(F.collect_list(F.struct("at", "seed", "source", "source_at")).alias("_m"))
    return lists.mapInArrow(run, T.StructType([T.StructField("seed", T.LongType()), met.schema["key"], T.StructField("at", T.IntegerType()),
                                               T.StructField("end", T.IntegerType())]))


class Maxima:
    """Greatest value of any run of places, each place a heap whose rows may expire."""

    def __init__(self, size: int):
        self.size, self.heaps = size, [[] for _ in range(size)]
        self.best = [(float("-inf"), -1)] * (2 * size)

    def _lift(self, at: int) -> None:
        heap = self.heaps[at]
        at += self.size
        self.best[at] = (-heap[0][0], -heap[0][1]) if heap else (float("-inf"), -1)
        while at > 1:
            at //= 2
            self.best[at] = max(self.best[2 * at], self.best[2 * at + 1])

    def put(self, at: int, value: float, row: int) -> None:
        heapq.heappush(self.heaps[at], (-value, -row))
        if self.heaps[at][0] == (-value, -row):
            self._lift(at)

    def drop(self, at: int, gone: list[bool]) -> None:
        """Rows marked as gone leave the place."""
        heap = self.heaps[at]
        if heap and gone[-heap[0][1]]:
            while heap and gone[-heap[0][1]]:
                heapq.heappop(heap)
            self._lift(at)

    def top(self, start: int, end: int) -> tuple[float, int]:
        """Best of places from ``start`` to before ``end``."""
        found = (float("-inf"), -1)
        start, end = start + self.size, end + self.size
        while start < end:
            if start & 1:
                found = max(found, self.best[start])
                start += 1
            if end & 1:
                end -= 1
                found = max(found, self.best[end])
            start, end = start // 2, end // 2
        return found


def segments(at: np.ndarray, source: np.ndarray, k: int, max_gap: int = MAX_GAP) -> list[tuple[int, int, int]]:
    """Matches merged along diagonals: (place, source place, words)."""
    order = np.lexsort((at, at - source))
    at, source = at[order], source[order]
    new = np.append(True, (np.diff(at - source) != 0) | (np.diff(at) > max_gap))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return sorted(zip(at[first].tolist(), source[first].tolist(), (at[last] - at[first] + k).tolist()))


def chains(parts: list[tuple[int, int, int]], gap_cost: float = GAP_COST, max_gap: int = MAX_GAP) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of segments in order in both texts, best first."""
    if len(parts) == 1:
        return [parts]
    ends = sorted({s + n for _, s, n in parts})
    rank = {e: i for i, e in enumerate(ends)}
    starts = np.searchsorted(ends, [s for _, s, _ in parts], side="right").tolist()
    lows = np.searchsorted(ends, [s - max_gap for _, s, _ in parts], side="left").tolist()
    tree, score, back = Maxima(len(ends)), [0.0] * len(parts), [-1] * len(parts)
    done = sorted(range(len(parts)), key=lambda i: parts[i][0] + parts[i][2])
    entered, expired, gone = 0, 0, [False] * len(parts)
    for i, (a, s, n) in enumerate(parts):  # in order of their start; segments enter once they have ended and leave beyond the gap
        while entered < len(done) and parts[done[entered]][0] + parts[done[entered]][2] <= a:
            j = done[entered]
            b, t, m = parts[j]
            tree.put(rank[t + m], score[j] + gap_cost * (b + m + t + m), j)
            entered += 1
        while expired < entered and parts[done[expired]][0] + parts[done[expired]][2] < a - max_gap:
            j = done[expired]
            gone[j] = True
            tree.drop(rank[parts[j][1] + parts[j][2]], gone)
            expired += 1
        best, j = tree.top(lows[i], starts[i])
        gain = best - gap_cost * (a + s)
        score[i], back[i] = (n + gain, j) if j >= 0 and gain > 0 else (float(n), -1)
    used, out = [False] * len(parts), []
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(parts[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == w)))
    return int(row[-1])


@functools.cache
def _edits(most: int) -> list[tuple[int, int]]:
    """Edits of up to so many words on either side, the smallest first."""
    return sorted(((i, j) for i in range(most + 1) for j in range(most + 1) if i or j), key=lambda s: (max(s), sum(s)))


def _extend(a: np.ndarray, b: np.ndarray, edits: int = 3, proof: int = 3) -> tuple[int, int, int]:
    """(words of a, words of b, matches) of a common start, over edits of up to so many words that ``proof`` equal words follow."""
    x = y = matches = 0
    while True:
        n = min(len(a) - x, len(b) - y)
        differ = np.flatnonzero(a[x : x + n] != b[y : y + n])
        run = int(differ[0]) if len(differ) else n
        x, y, matches = x + run, y + run, matches + run
        for i, j in _edits(edits):
            p, q = a[x + i : x + i + proof], b[y + j : y + j + proof]
            if len(p) == proof == len(q) and (p == q).all():
                x, y = x + i, y + j
                break
        else:
            return x, y, matches


def passage(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """(start, end, source start, source end, matching words) of a chain, aligned and extended."""
    matches, x, y = 0, chain[0][0], chain[0][1]
    for at, source, n in chain:
        matches += _common(a[x:at], b[y:source])
        matches += int((a[at : at + n] == b[source : source + n]).sum())
        x, y = at + n, source + n
    right = _extend(a[x:], b[y:])
    start, first = chain[0][:2]
    left = _extend(a[:start][::-1], b[:first][::-1])
    return start - left[0], x + right[0], first - left[1], y + right[1], matches + left[2] + right[2]


def _words(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts, data, ends = words.texts_of(batch.column("text")), [], [0]
                for some in words.groups(texts):
                    hashes, bounds = words.word_hashes(texts[some], words.LETTERS)
                    data.append(hashes.astype(np.uint32).view(np.int32))
                    ends += (ends[-1] + bounds[1:]).tolist()
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(data)))
                yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "words"])

    return words.map_texts(docs, run, T.StructType([docs.schema["key"], T.StructField("words", T.ArrayType(T.IntegerType()))]))


def find(docs: DataFrame, key: str = "doc_id", content: str = "text", k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS,
         min_identity: float = MIN_IDENTITY, min_span: int = MIN_SPAN) -> DataFrame:
    """One row per repeated passage: key, start_word, end_word, source_id, source_start, source_end, matching_words, identity."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("key"), F.col(content).alias("text")).filter(F.col("key").isNotNull())
    with scratch(spark):
        with scratch(spark):
            pairs = materialise(_pairs(texts, k, window, min_words, min_span), "pairs", keep=True)
        needed = materialise(pairs.select(F.explode(F.array("key", "source")).alias("key")).distinct(), "needed")
        read = lookup_join(texts, needed, "key").groupBy("key").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
        held = materialise(_words(read), "words")
        left = pairs.join(held.withColumnRenamed("words", "_a"), "key")
        both = salted_join(left, held.select(F.col("key").alias("source"), F.col("words").alias("_b")), "source", "key", per_task=1000)
        found = materialise(_aligned(both, texts.schema["key"], k, min_words, min_identity, min_span), "passages", keep=True)
    return found.select(F.col("key").alias(key), "start_word", "end_word", F.col("source").alias("source_id"),
                        "source_start", "source_end", "matching_words", "identity")


def _pairs(texts: DataFrame, k: int, window: int, min_words: int, min_span: int) -> DataFrame:
    """(key, source, at, source_at): documents with enough matches with one earlier document; its tables are the caller's to drop."""
    # made anew for each use: a table of all seeds would be as large as the texts
    all_seeds = seeds(texts, k, window)
    first = all_seeds.groupBy("seed").agg(F.min(F.struct("key", "at")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = materialise(first.filter("_n > 1").select("seed", F.col("_first.key").alias("source"), F.col("_first.at").alias("source_at"), "_n"), "firsts")
    met = materialise(lookup_join(all_seeds, first, "seed", "_n").drop("_n"), "met")
    # where seeds near each other point to several places, the two together are matched with their own first holder
    far = materialise(seams(met, min_span - k, min_words), "seams")
    holder = far.groupBy("seed").agg(F.min(F.struct("key", "at", "end")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    holder = materialise(holder.filter("_n > 1").select("seed", F.col("_first.key").alias("source"), F.col("_first.at").alias("source_at"),
                                                        F.col("_first.end").alias("source_end"), "_n"), "seam-firsts")
    ends = F.inline(F.array(F.struct("at", "source_at"), F.struct(F.col("end").alias("at"), F.col("source_end").alias("source_at"))))
    both_ends = lookup_join(far, holder, "seed", "_n").select("key", "source", ends)
    matches = met.select("key", "source", "at", "source_at").unionByName(both_ends).filter(F.col("key") != F.col("source"))
    pairs = matches.groupBy("key", "source").agg(
        F.collect_set(F.struct("at", "source_at")).alias("_m"), F.min("at").alias("_low"), F.max("at").alias("_high"))
    pairs = pairs.filter((F.size("_m") > 1) & (F.col("_high") - F.col("_low") + k >= min_span))
    return pairs.select("key", "source", F.col("_m.at").alias("at"), F.col("_m.source_at").alias("source_at"))


def _aligned(both: DataFrame, key: T.StructField, k: int, min_words: int, min_identity: float, min_span: int) -> DataFrame:
    """Chains and alignments of pairs with both texts' words."""
    names = ("start_word", "end_word", "source_start", "source_end", "matching_words")
    out = T.StructType([key, T.StructField("source", key.dataType)]
                       + [T.StructField(n, T.LongType()) for n in names] + [T.StructField("identity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                at, source_at, a, b = (batch.column(c) for c in ("at", "source_at", "_a", "_b"))
                rows, found = [], []
                for i in range(batch.num_rows):
                    places, sources, x, y = (np.asarray(c[i].values) for c in (at, source_at, a, b))
                    taken: list[tuple[int, int]] = []
                    for chain in chains(segments(places.astype(np.int64), sources.astype(np.int64), k)):
                        if chain[-1][0] + chain[-1][2] - chain[0][0] < min_span or any(s <= chain[0][0] < e for s, e in taken):
                            continue
                        low, high, first_, last, matches = passage(chain, x, y)
                        length = max(high - low, last - first_)
                        if high - low >= min_words and matches >= min_identity * length:
                            taken.append((low, high))
                            rows.append(i)
                            found.append((low, high, first_, last, matches, matches / length))
                columns = list(zip(*found)) if found else [[]] * 6
                kinds = [pa.int64()] * 5 + [pa.float64()]
                pick = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pick), batch.column("source").take(pick)]
                                                 + [pa.array(c, t) for c, t in zip(columns, kinds)], names=out.names)

    return both.mapInArrow(run, out)
