"""Product codes of vectors: integer k-means per part, nearest entries found by Orchard's search.

A component x counts as floor(1024 x). Vectors are cut into equal consecutive parts, each part position has a codebook
that starts as that part of the vectors of least id, and every round assigns all parts to their nearest entry (squared
distance, ties to the lower index) and replaces used entries by floor(sum / count).

Orchard's search: every entry keeps a list of all entries by distance from it. A query holds a current entry, walks that
entry's list, and moves to the list of any entry that is nearer (or as near with a lower index). An entry farther from
the current one than twice the current distance cannot be nearer than it, by the triangle inequality, so the walk stops
there. Visited entries are marked and never compared again. All queries of a batch walk in step, each comparing the next
``STRIDE`` entries of its list and moving to the best of them. Arithmetic is exact: in doubles where squared
distances stay below 2^53, else in Python integers.

Each round is one pass: tasks add up their own parts, so a shuffle holds at most entries x parts sums a task, and the
codebooks (at most entries x dimension numbers) are all that meets the driver.

Cases: a null vector, or one with null or non-finite components, is dropped; with fewer vectors than entries the codebooks
are shorter; null ids come after all others and are coded too; of vectors with one id the lesser by its components comes
first. Vectors whose length is not the commonest one (ties: the longer), or no multiple of the parts, cannot be cut
alike, and vectors with a component of 2^32 or more overflow sums: these rows keep a null code and error. An error of
2^63 or more is null. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.scale import lookup_join
from ..session import materialise

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
STRIDE = 32
QUERIES_AT_ONCE = 1 << 10
LARGEST = 2.0**32


class Lists(NamedTuple):
    """A codebook with, per entry, the others by distance from it: their numbers, those squared distances, and the
    entries themselves with their own squared lengths, cut into blocks of ``STRIDE``. The last block is filled up with
    the entry itself, out of reach."""

    entries: np.ndarray
    near: np.ndarray
    far: np.ndarray
    laid: np.ndarray
    norms: np.ndarray


def lists(entries: np.ndarray) -> Lists:
    entries = _exact(entries)
    n, width = entries.shape
    norms = (entries * entries).sum(1)
    squares = norms[:, None] + norms - 2 * (entries @ entries.T)
    near = np.argsort(squares, axis=1, kind="stable")
    blocks = -(-n // STRIDE)
    fill = (0, 0), (0, blocks * STRIDE - n)
    far = np.pad(np.take_along_axis(squares, near, 1), fill, constant_values=np.inf)
    near = np.pad(near, fill)
    return Lists(entries, near.reshape(n * blocks, STRIDE), far.reshape(n * blocks, STRIDE), entries[near].reshape(n * blocks, STRIDE, width),
                 norms[near].reshape(n * blocks, STRIDE))


def _exact(values: np.ndarray) -> np.ndarray:
    """Doubles if no squared distance can leave their exact range, else Python integers."""
    widest = 2 * float(np.abs(values).max(initial=0))
    return values if widest * widest * max(1, values.shape[-1]) < 2.0**53 else _integers(values)


def _integers(values: np.ndarray) -> np.ndarray:
    return values if values.dtype == object else np.vectorize(int, otypes=[object])(values)


def orchard(queries: np.ndarray, book: Lists) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry, squared distance) of each query, and the number of distances compared."""
    entries, near, far, laid, norms = book
    n, blocks = len(entries), len(near) // len(entries)
    own = (queries * queries).sum(1)
    current, place = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)  # place: row of a list's block
    best = ((queries - entries[0]) ** 2).sum(1)
    visited = np.zeros(len(queries) * n, bool)
    visited[::n] = True
    active, compared = np.arange(len(queries)), len(queries)
    while len(active):
        at, here, so_far = place[active], current[active], best[active]
        others = near.take(at, 0)
        marks = others + (active * n)[:, None]
        able = far.take(at, 0) <= 4 * so_far[:, None]
        able &= ~visited.take(marks)
        visited[marks[able]] = True
        compared += np.count_nonzero(able)
        products = np.matmul(laid.take(at, 0), queries[active][:, :, None])[:, :, 0]
        squares = np.where(able, norms.take(at, 0) + own[active][:, None] - 2 * products, np.inf)
        least = squares.min(1)
        entry = np.where(squares == least[:, None], others, n).min(1)
        nearer = (least < so_far) | ((least == so_far) & (entry < here))
        moved = active[nearer]
        place[active] = at + 1
        current[moved], best[moved], place[moved] = entry[nearer], least[nearer], entry[nearer] * blocks
        at = place[active]
        active = active[at < (current[active] + 1) * blocks]
        active = active[(far[place[active], 0] <= 4 * best[active]).astype(bool)]
    return current, best, compared


def assign(vectors: np.ndarray, books: list[Lists]) -> tuple[np.ndarray, list[int]]:
    """Entry of each part (n x parts) and the squared distances summed over the parts."""
    width = vectors.shape[1] // len(books)
    found, errors = np.zeros((len(vectors), len(books)), np.int64), []
    for at in range(0, len(vectors), QUERIES_AT_ONCE):
        rows = slice(at, at + QUERIES_AT_ONCE)
        total = 0
        for p, book in enumerate(books):
            queries = vectors[rows, p * width : (p + 1) * width]
            if queries.dtype != book.entries.dtype:
                queries, book = _integers(queries), book._replace(entries=_integers(book.entries), laid=_integers(book.laid), norms=_integers(book.norms))
            found[rows, p], best, _ = orchard(queries, book)
            total = total + best
        errors += [int(e) for e in total]
    return found, errors


def _scaled(column: pa.Array, width: int) -> np.ndarray:
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    return _exact(np.floor(values * SCALE))


def _books(codebooks: np.ndarray) -> list[Lists]:
    return [lists(c) for c in codebooks]


class Codebooks(NamedTuple):
    """Integer codebooks, parts x entries x part width."""

    values: np.ndarray

    @property
    def sha256(self) -> str:
        """Digest of all components by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(str(int(v)) for v in self.values.ravel()).encode()).hexdigest()


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    return vectors.filter(F.col(column).isNotNull() & F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def codable(rows: DataFrame, column: str = "embedding", parts: int = PARTS) -> tuple[int, Column]:
    """(length, condition) of the vectors that can be cut alike and summed."""
    counts = rows.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = counts["n"] if counts and counts["n"] % parts == 0 else 0
    small = F.forall(column, lambda x: F.abs(x) < LARGEST)
    return length, (F.size(column) == length) & small if length else F.lit(False)


def train(rows: DataFrame, length: int, key: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds over vectors of one length."""
    firsts = rows.select(key, column).orderBy(F.col(key).asc_nulls_last(), column).limit(entries).collect() if length else []
    width = length // parts
    start = np.floor(np.array([r[column] for r in firsts], np.float64) * SCALE)
    values = start.reshape(len(firsts), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if len(firsts) else 0):
        sums = _sums(rows, column, values).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)])
        values = values.astype(object)
        for r in sums.collect():  # at most parts x entries rows
            values[r["part"], r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
        values = values.astype(np.float64)  # entries are below LARGEST * SCALE
    return Codebooks(values)


def _sums(rows: DataFrame, column: str, values: np.ndarray) -> DataFrame:
    """(part, entry, n, total) added up per task; a total of 2^20 rows below LARGEST fits a long."""
    parts, entries, width = values.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [lists(c) for c in values]
        numbers = np.zeros((parts, entries), np.int64)
        totals = np.zeros((parts, entries, width), np.int64)
        held = 0
        for batch in batches:
            vectors = _scaled(batch.column(0), parts * width)
            found, _ = assign(vectors, books)
            whole = vectors.astype(np.int64)
            if held + len(whole) > 1 << 20:
                yield _sum_rows(numbers, totals)
                numbers[:], totals[:], held = 0, 0, 0
            held += len(whole)
            for p in range(parts):
                np.add.at(numbers[p], found[:, p], 1)
                np.add.at(totals[p], found[:, p], whole[:, p * width : (p + 1) * width])
        yield _sum_rows(numbers, totals)

    return rows.select(column).mapInArrow(run, "part int, entry int, n long, total array<long>")


def _sum_rows(numbers: np.ndarray, totals: np.ndarray) -> pa.RecordBatch:
    part, entry = np.nonzero(numbers)
    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * totals.shape[2])
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(numbers[part, entry]),
         pa.ListArray.from_arrays(offsets, pa.array(totals[part, entry].ravel(), pa.int64()))], names=["part", "entry", "n", "total"])


def encode(rows: DataFrame, books: Codebooks, able: Column, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """(key, label, code, error): two hex digits per part, as wide as the entries need; null where ``able`` does not hold."""
    values = books.values
    out = T.StructType([T.StructField("_key", rows.schema[key].dataType), T.StructField("_label", rows.schema[label].dataType),
                        T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_lists = [lists(c) for c in values]
        for batch in batches:
            vectors = batch.column("_vector")
            codes, errors = [None] * len(vectors), [None] * len(vectors)
            at = np.flatnonzero(np.asarray(vectors.is_valid()))
            if len(at):
                found, error = assign(_scaled(vectors.drop_null(), values.shape[0] * values.shape[2]), found_lists)
                for i, part, e in zip(at.tolist(), found.astype(np.uint8), error):
                    codes[i], errors[i] = part.tobytes().hex(), e if e < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_label"), pa.array(codes, pa.string()),
                                              pa.array(errors, pa.int64())], names=out.names)

    chosen = rows.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.when(able, F.col(column)).alias("_vector"))
    return chosen.mapInArrow(run, out).withColumnsRenamed({"_key": key, "_label": label})


def compress(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """Train codebooks on all codable vectors and encode every usable row."""
    rows = usable(vectors.select(key, column, label), column)
    length, able = codable(rows, column)
    books = train(rows.filter(able), length, key, column)
    return encode(rows, books, able, key, column, label), books


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Errors summed over equal labels (nulls together) beside each row."""
    coded = materialise(coded.withColumn("_kind", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))), "codes")
    totals = materialise(coded.groupBy("_kind").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label_errors")
    return lookup_join(coded, totals, "_kind", "_n").drop("_kind", "_n")
