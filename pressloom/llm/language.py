"""Language identification by a convolutional network over bytes, trained and applied in numpy.

A text is cut into windows of ``WINDOW`` bytes. Each byte has an embedding; filters of several widths slide over a
window, a rectifier and the maximum over the window give one value per filter, and a softmax layer gives the
languages' probabilities. A text's prediction is the language with the highest mean log-probability over all of its
windows, weighted by their bytes; its score is that language's share.

Filters of all widths are one matrix over the widest span (narrow ones are zero beyond their width), so a batch of
windows is a single product. Training reads at most ``train_docs`` documents with a language outside the held-out
fifth (least hash of the key first) and ``train_windows`` windows of each; both are parameters. Applying the model
reads whole texts in the tasks and shuffles nothing.

Cases: null text or text without a letter is ``und`` with score 1; an empty text too; a null key is predicted and
not held out; rows that repeat get the same result; with no labelled rows every text is ``und`` with score 0; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .quality import held_out
from .words import texts_of

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8  # of each width
EMBED = 6
SPAN = max(WIDTHS)
TRAIN_DOCS, TRAIN_WINDOWS = 2000, 3
FOLDS, HELD = 5, 0
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
BATCH = 512  # windows at once


def windows_of(text: bytes) -> np.ndarray:
    """The text as rows of WINDOW bytes that overlap by the filters' reach; zero fills the last one."""
    step = WINDOW - SPAN + 1
    number = max(1, -(-max(0, len(text) - SPAN + 1) // step))
    padded = np.zeros(number * step + SPAN - 1, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


class ByteNet:
    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embedding[0] = 0
        self.reach = np.concatenate([np.repeat(np.arange(SPAN)[:, None] < w, FILTERS, 1) for w in WIDTHS], 1)
        self.filters = rng.normal(0, 0.3, (SPAN, EMBED, len(WIDTHS) * FILTERS)).astype(np.float32) * self.reach[:, None]
        self.shift = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.top = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, max(1, len(languages)))).astype(np.float32)
        self.bias = np.zeros(max(1, len(languages)), np.float32)

    def _spans(self, rows: np.ndarray) -> np.ndarray:
        """(windows x places) rows of the embedded bytes under the widest filter."""
        places = rows.shape[1] - SPAN + 1
        e = self.embedding[rows]
        return np.concatenate([e[:, j : j + places] for j in range(SPAN)], 2).reshape(len(rows) * places, SPAN * EMBED)

    def _pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spans = self._spans(rows)
        found = (spans @ self.filters.reshape(SPAN * EMBED, -1)).reshape(len(rows), -1, len(self.shift))
        return spans, found, found.max(1) + self.shift

    def log_shares(self, rows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(rows), BATCH):
            _, _, pooled = self._pooled(rows[at : at + BATCH])
            logits = np.maximum(pooled, 0) @ self.top + self.bias
            logits -= logits.max(1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.bias)), np.float32)

    def fit(self, rows: np.ndarray, labels: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 0) -> "ByteNet":
        """Cross-entropy by Adam; a part of each batch is cut short, as short texts will be."""
        rng = np.random.default_rng(seed)
        params = [self.embedding, self.filters, self.shift, self.top, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for t in range(1, steps + 1):
            chosen = rng.integers(0, len(rows), batch)
            x, y = rows[chosen].copy(), labels[chosen]
            for i in range(0, batch, 3):
                x[i, rng.integers(6, WINDOW):] = 0
            spans, found, pooled = self._pooled(x)
            hidden = np.maximum(pooled, 0)
            logits = hidden @ self.top + self.bias
            share = np.exp(logits - logits.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            share[np.arange(batch), y] -= 1
            share /= batch
            back = (share @ self.top.T) * (pooled > 0)
            place = found.argmax(1)
            picked = spans.reshape(batch, -1, SPAN * EMBED)[np.arange(batch)[:, None], place]  # batch x filters x span
            by_filter = np.einsum("bf,bfs->sf", back, picked).reshape(self.filters.shape) * self.reach[:, None]
            by_byte = np.zeros_like(self.embedding)
            flat = self.filters.transpose(2, 0, 1)
            for j in range(SPAN):
                np.add.at(by_byte, x[np.arange(batch)[:, None], place + j], back[:, :, None] * flat[None, :, j])
            by_byte[0] = 0
            slopes = [by_byte, by_filter, back.sum(0), hidden.T @ share, share.sum(0)]
            for p, g, (m, v) in zip(params, slopes, moments):
                m[...] = 0.9 * m + 0.1 * g
                v[...] = 0.999 * v + 0.001 * g * g
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [1.0 if self.languages else 0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if LETTER.search(t.decode("utf-8", "replace"))] if self.languages else []
        rows = [windows_of(texts[i]) for i in able]
        start = 0
        while start < len(able):  # texts of about BATCH windows together
            end, held = start, 0
            while end < len(able) and (not held or held + len(rows[end]) <= BATCH):
                held += len(rows[end])
                end += 1
            logs = self.log_shares(np.concatenate(rows[start:end]) if end - start > 1 else rows[start])
            at = 0
            for i, own in zip(able[start:end], rows[start:end]):
                weight = np.full(len(own), float(WINDOW))
                weight[-1] = max(1, len(texts[i]) - (len(own) - 1) * (WINDOW - SPAN + 1))
                mean = (logs[at : at + len(own)] * weight[:, None]).sum(0) / weight.sum()
                at += len(own)
                share = np.exp(mean - mean.max())
                best = int(share.argmax())
                names[i], scores[i] = self.languages[best], float(share[best] / share.sum())
            start = end
        return names, scores


def train(docs: DataFrame, key: str = "doc_id", content: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS,
          train_windows: int = TRAIN_WINDOWS) -> ByteNet:
    """Fit on documents with a language outside the held-out fold."""
    able = docs.filter(F.col(lang).isNotNull() & F.col(content).isNotNull() & ~held_out(key, FOLDS, HELD))
    chosen = able.select(F.col(key).alias("_key"), F.col(lang).alias("lang")).distinct().orderBy(
        F.xxhash64("_key"), "_key", "lang").limit(train_docs)
    rows = able.select(F.col(key).alias("_key"), F.col(lang).alias("lang"), F.col(content).alias("text")).join(
        F.broadcast(chosen), ["_key", "lang"])  # at most train_docs rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, kept = [], []
            for name, text in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text"))):
                own = windows_of(text)
                for i in sorted({(len(own) - 1) * j // max(1, train_windows - 1) for j in range(train_windows)}):
                    langs.append(name)
                    kept.append(own[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(kept, pa.binary())], names=["lang", "row"])

    sample = sorted({(r["lang"], bytes(r["row"])) for r in rows.mapInArrow(run, "lang string, row binary").toLocalIterator()})
    languages = sorted({name for name, _ in sample})
    net = ByteNet(languages)
    if len(languages) > 1:
        data = np.frombuffer(b"".join(row for _, row in sample), np.uint8).reshape(-1, WINDOW)
        net.fit(data, np.array([languages.index(name) for name, _ in sample]))
    return net


def predict(docs: DataFrame, net: ByteNet, key: str = "doc_id", content: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, lang_pred, score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = net.predict(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["_key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("_key"), F.col(content).alias("text"))
    out = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out).select(
        F.col("_key").alias(key), held_out("_key", FOLDS, HELD).alias("held_out"), "lang_pred", "score")
