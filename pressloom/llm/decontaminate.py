"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Words are compared without case and punctuation. A test item's seeds are its word n-grams, all of them however
frequent, so an item is found in the same way whether it leaked once or into a third of the corpus. One pass joins
the documents' n-grams to the seeds; where a document holds two seeds of an item (one, if the item has no more than
two), the passage around them is aligned with the item word by word (match 2, mismatch and gap -1), and the
alignment's score over the item's best possible score is the similarity. Before that, a passage is left out only if
no stretch of it holds enough of the item's words for the least similarity, which loses nothing. Edited, shortened
or padded copies align; texts that share a few phrases do not.

Items go to the tasks in blocks of ``block_items``, the only thing that is broadcast; a larger test set takes more
passes. Documents are never shuffled.

Cases: null and empty documents or items match nothing; an item of fewer words than a seed is sought as one seed;
items with the same text are each reported; rows that repeat are each reported; a document of any length is read
whole; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import words

SEED_WORDS = 3
MIN_SIMILARITY = 0.5
BLOCK_ITEMS = 20_000
FILTER_BITS = 1 << 22


class Seeds:
    """Distinct seed hashes of a block of items, looked up for whole arrays behind a one-bit filter."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.filter = np.zeros(FILTER_BITS, bool)
        self.filter[(hashes % np.uint64(FILTER_BITS)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a seed stands, and which seed."""
        at = np.flatnonzero(self.filter[(grams & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        real = self.hashes[row] == grams[at]
        return at[real], row[real]


def _seeds_of(item: np.ndarray, k: int) -> np.ndarray:
    return words.ngrams(item, min(k, len(item))) if len(item) else item


def _grams(doc: np.ndarray, lengths: list[int], k: int) -> Iterator[np.ndarray]:
    """The document's n-grams, for each seed length (short items have shorter ones)."""
    for n in lengths:
        if len(doc) >= n:
            yield words.ngrams(doc, n)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first, end) in the passage."""
    n = len(passage)
    step = np.arange(n + 1)
    before, start = np.zeros(n + 1, np.int64), step.copy()
    best, first, end = 0, 0, 0
    for w in item:
        diagonal = before[:-1] + np.where(passage == w, 2, -1)
        up = before - 1
        score = np.maximum(up, 0)
        origin = np.where(up > 0, start, step)
        better = diagonal > score[1:]
        score[1:] = np.where(better, diagonal, score[1:])
        origin[1:] = np.where(better, start[:-1], origin[1:])
        run = np.maximum.accumulate(score + step)  # gaps in the item: the best cell to the left, one point per word
        left = run - step
        source = np.maximum.accumulate(np.where(score + step == run, step, 0))
        origin = np.where(left > score, origin[source], origin)
        before, start = np.maximum(score, left), origin
        top = int(before.argmax())
        if before[top] > best:
            best, first, end = int(before[top]), int(start[top]), top
    return best, first, end


def _passages(at: np.ndarray, item_words: int) -> Iterator[tuple[int, int]]:
    """Runs of seed positions no further apart than the item is long."""
    cuts = np.flatnonzero(np.diff(at) > item_words) + 1
    for run in np.split(at, cuts):
        yield int(run[0]), int(run[-1])


def _scan(docs: DataFrame, visit, schema: T.StructType) -> DataFrame:
    """Run ``visit(words of a document)`` -> rows over all documents; rows get the document's key in front."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = words.texts_of(batch.column("text")), batch.column("key")
            found, rows = [], []
            for some in words.groups(texts):
                hashes, bounds = words.word_hashes(texts[some], words.LETTERS)
                for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), some.start):
                    for row in visit(hashes[s:e]):
                        found.append(i)
                        rows.append(row)
            columns = [pa.array(c, f) for c, f in zip(zip(*rows) if rows else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(found, pa.int64())), *columns], names=names)

    names = schema.names
    kinds = {T.LongType: pa.int64(), T.DoubleType: pa.float64()}
    types = [kinds[type(f.dataType)] for f in schema.fields[1:]]
    return docs.mapInArrow(run, schema)


def _may_reach(item: np.ndarray, passage: np.ndarray, least: float) -> bool:
    """Whether an alignment may reach ``least``: it takes as many words of the item, in a stretch its gaps can pay for."""
    wanted = math.ceil(least * len(item) - 1e-9)
    held = np.concatenate(([0], np.cumsum(np.isin(passage, item))))
    span = min(len(passage), math.ceil((3 - 2 * least) * len(item)))
    return int((held[span:] - held[: len(held) - span]).max()) >= wanted


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", content: str = "text", item_key: str = "item_id",
         item_content: str = "text", k: int = SEED_WORDS,
         min_similarity: float = MIN_SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document and item that leaked into it: key, item key, similarity, first_word, end_word."""
    texts = docs.select(F.col(key).alias("key"), F.col(content).alias("text"))
    item_type = items.schema[item_key].dataType
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("_item", T.LongType()),
                           T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()),
                           T.StructField("end_word", T.LongType())])
    out = None
    block: list = []
    rows = items.select(F.col(item_key).alias("k"), F.col(item_content).alias("t")).toLocalIterator()
    while block := [r for _, r in zip(range(block_items), rows)]:
        found = _find_block(texts, [r.t for r in block], k, min_similarity, schema)
        names = docs.sparkSession.createDataFrame(
            [(i, r.k) for i, r in enumerate(block)], T.StructType([T.StructField("_item", T.LongType()), T.StructField(item_key, item_type)]))
        found = found.join(F.broadcast(names), "_item").select(  # at most block_items rows
            F.col("key").alias(key), item_key, "similarity", "first_word", "end_word")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], T.StructType(
            [T.StructField(key, schema[0].dataType), T.StructField(item_key, item_type), *schema.fields[2:]]))
    return out


def _find_block(texts: DataFrame, contents: list[str | None], k: int, min_similarity: float, schema: T.StructType) -> DataFrame:
    known = [words.word_hashes([(t or "").encode()], words.LETTERS)[0] for t in contents]
    seeds_of = [np.unique(_seeds_of(w, k)) for w in known]
    lengths = sorted({min(k, len(w)) for w in known if len(w)})
    seeds = np.unique(np.concatenate([*seeds_of, np.zeros(0, np.uint64)]))
    if not len(seeds):
        return texts.sparkSession.createDataFrame([], schema)
    needed = np.array([1 if len(own) <= 2 else 2 for own in seeds_of])
    # items of seed s: item_of[from_[s] : from_[s + 1]]
    row_of = np.searchsorted(seeds, np.concatenate(seeds_of))
    item_of = np.repeat(np.arange(len(known)), [len(own) for own in seeds_of])[np.argsort(row_of, kind="stable")]
    from_ = np.searchsorted(np.sort(row_of), np.arange(len(seeds) + 1))
    table = Seeds(seeds)

    def visit(doc: np.ndarray):
        hits = [table.find(g) for g in _grams(doc, lengths, k)]
        at, row = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 2
        if not len(at):
            return
        many = from_[row + 1] - from_[row]
        first_of = np.repeat(from_[row] - np.cumsum(many) + many, many)
        pairs = np.unique(np.stack((item_of[first_of + np.arange(len(first_of))], np.repeat(at, many)), 1), axis=0)
        cuts = np.append(np.flatnonzero(np.diff(pairs[:, 0], prepend=-1)), len(pairs))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            i = int(pairs[s, 0])
            if e - s < needed[i]:
                continue
            item, best = known[i], (0.0, 0, 0)
            for first, last in _passages(pairs[s:e, 1], len(item)):
                low = max(0, first - len(item))
                passage = doc[low : last + len(item) + k]
                if not _may_reach(item, passage, min_similarity):
                    continue
                score, start, end = align(item, passage)
                best = max(best, (score / (2 * len(item)), -(low + start), low + end))
            if best[0] >= min_similarity:
                yield i, best[0], -best[1], best[2]

    return _scan(texts, visit, schema)


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents into which no item leaked; a null key is compared like any other value."""
    leaked = find(docs, items, key, **options).select(F.col(key).alias("_leaked")).distinct()
    return docs.join(leaked, docs[key].eqNullSafe(leaked["_leaked"]), "left_anti")
