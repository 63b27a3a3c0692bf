"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad from its own features and those of the lines beside it: shares
of byte classes, word lengths, repeated words. The field is trained on lines that carry their document's label.
A document's quality is the mean of its lines' forward-backward marginals, weighted by line length, passed through
a logistic curve fitted on the training documents.

Training reads at most ``train_docs`` labelled documents (least hash of the key first) and of each at most
``train_lines`` lines in a row; both are parameters, and rows of the held-out third are never read. Scoring reads
whole texts in the tasks and shuffles nothing.

Cases: null and empty text is one empty line and gets a score too; a null key is scored and not held out; rows that
repeat get the same score; a text of any length is read whole; with no labelled rows every score is 0.5; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import words
from .crf import Chain

TRAIN_DOCS = 2000
TRAIN_LINES = 32
FOLDS, HELD = 3, 1

LOWER, UPPER, DIGIT, SPACE, SHOUT, MARK, BAR, STOP, COMMA, OTHER, WIDE, LEAD = range(12)
_kinds = np.full(256, OTHER, np.uint8)
_kinds[128:] = WIDE
_kinds[0xC3] = LEAD
_kinds[97:123], _kinds[65:91], _kinds[48:58] = LOWER, UPPER, DIGIT
for _signs, _kind in ((b" \t\r\x0b\x0c", SPACE), (b"!?", SHOUT), (b"#$%&*@^~=+<>{}[]\\/_", MARK), (b"|", BAR), (b".", STOP), (b",;:", COMMA)):
    _kinds[list(_signs)] = _kind
EDGES = (0.01, 0.05, 0.15, 0.4)
OWN = 14 * (1 + len(EDGES)) + 6
FEATURES = 3 * OWN


def held_out(key: str, folds: int = FOLDS, held: int = HELD) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == held, F.lit(False))


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, bytes of every line, bounds: the lines of text i are bounds[i]:bounds[i+1])."""
    data = b"\n".join(texts) + b"\n"
    a = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(a == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = ends - starts
    kind = _kinds[a]
    after = np.flatnonzero(kind[:-1] == LEAD) + 1  # second byte of a Latin-1 letter: its case
    kind[after] = np.where(a[after] < 0xA0, UPPER, LOWER)
    line = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    counts = np.bincount(line * 12 + kind, minlength=12 * len(ends)).reshape(-1, 12).astype(np.float32)
    counts[:, OTHER] -= 1  # the line feed itself
    inside = np.concatenate(([False], (kind != SPACE) & (a != 10)))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = turns[::2], turns[1::2]
    hashes = words.span_hashes(a, first, last)
    of = np.searchsorted(ends, first)
    number = np.bincount(of, minlength=len(ends)).astype(np.float32)
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1]))) if len(of) else np.zeros(0, bool)
    repeats = np.bincount(of[same], minlength=len(ends)).astype(np.float32)
    long_ = np.bincount(of[last - first > 18], minlength=len(ends)).astype(np.float32)
    total, many = np.maximum(size, 1).astype(np.float32), np.maximum(number, 1)
    share = np.concatenate((counts / total[:, None], (repeats / many)[:, None], (long_ / many)[:, None]), 1)
    steps = [share] + [share > edge for edge in EDGES]
    shape = np.stack((size == 0, number <= 2, number <= 6, number >= 40, size / many / 10, np.log1p(size) / 8), 1)
    own = np.concatenate((*steps, shape), 1).astype(np.float32)
    lengths = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    before[bounds[:-1]] = 0
    behind[bounds[1:] - 1] = 0
    return np.concatenate((own, before, behind), 1), size, bounds


def _chains(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for some in words.groups(texts):
        x, size, bounds = line_features(texts[some])
        for i, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), some.start):
            yield i, x[s:e], size[s:e]


def quality_of(marginals: np.ndarray, size: np.ndarray) -> float:
    weight = np.maximum(size, 1)
    return float((marginals * weight).sum() / weight.sum())


def _log_odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))


class QualityModel:
    def __init__(self, chain: Chain, slope: float, level: float):
        self.chain, self.slope, self.level = chain, slope, level

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for some in words.groups(texts):
            x, size, bounds = line_features(texts[some])
            emission = self.chain.emission(x)
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            for i, ((s, e), m) in enumerate(zip(spans, self.chain.marginals([emission[s:e] for s, e in spans])), some.start):
                out[i] = quality_of(m, size[s:e])
        return 1 / (1 + np.exp(-(self.slope * _log_odds(out) + self.level)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", content: str = "text", label: str = "quality",
          train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> QualityModel:
    """Fit on labelled documents outside the held-out fold."""
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(
        F.min(label).alias("_label")).orderBy(F.xxhash64("_key"), "_key").limit(train_docs)
    rows = docs.select(F.col(key).alias("_key"), F.col(content).alias("text")).join(F.broadcast(chosen), "_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, found, sizes = batch.column("_label").to_pylist(), [], []
            for _, x, size in _chains(words.texts_of(batch.column("text"))):
                at = int(size.sum()) % max(1, len(x) - train_lines + 1)
                found.append(x[at : at + train_lines].tobytes())
                sizes.append(size[at : at + train_lines].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(wanted, pa.int64()), pa.array(found, pa.binary()), pa.array(sizes, pa.list_(pa.int64()))],
                names=["key", "label", "x", "size"])

    out = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("label", T.LongType()),
                        T.StructField("x", T.BinaryType()), T.StructField("size", T.ArrayType(T.LongType()))])
    # bounded: train_docs documents of train_lines lines; rows that repeat a key are told apart by nothing and count once
    held = {r["key"]: r for r in rows.mapInArrow(run, out).toLocalIterator()}
    sample = [held[k] for k in sorted(held)]
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in sample]
    ys = np.array([r["label"] for r in sample], float)
    chain = Chain(FEATURES)
    if not len(ys) or ys.min() == ys.max():
        return QualityModel(chain, 0.0, 0.0 if not len(ys) else (4.0 if ys[0] else -4.0))
    chain.fit([(x, np.full(len(x), y)) for x, y in zip(xs, ys)])
    share = np.array([quality_of(m, np.array(r["size"])) for m, r in zip(chain.marginals([chain.emission(x) for x in xs]), sample)])
    odds, slope, level = _log_odds(share), 1.0, 0.0
    for _ in range(30):  # Newton steps of a two-parameter logistic curve, lightly held near slope 1
        p = 1 / (1 + np.exp(-(slope * odds + level)))
        g = np.array([((p - ys) * odds).sum() + (slope - 1), (p - ys).sum() + level * 0.1])
        v = p * (1 - p)
        h = np.array([[(v * odds**2).sum() + 1, (v * odds).sum()], [(v * odds).sum(), v.sum() + 0.1]])
        slope, level = np.array([slope, level]) - np.clip(np.linalg.solve(h, g), -1, 1)
    return QualityModel(chain, float(slope), float(level))


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id", content: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score, predicted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(words.texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(scores)], names=["_key", "score"])

    rows = docs.select(F.col(key).alias("_key"), F.col(content).alias("text"))
    scored = rows.mapInArrow(run, T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("_key").alias(key), held_out("_key").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, content: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; columns and order of columns stay."""
    at = docs.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(words.texts_of(batch.column(at))) >= 0.5))

    return words.map_texts(docs, run, docs.schema)
