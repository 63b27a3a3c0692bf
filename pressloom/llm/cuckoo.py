"""Exact de-duplication over an index of live digests: cuckoo filters with insertion, deletion and resizing.

The index is sharded by digest. A shard is a cuckoo filter (buckets of four 16-bit fingerprints, two candidate
buckets per key) beside the full digests in the same bucket layout: a fingerprint hit is only a hit when the
stored digest agrees, so false positives cost a comparison and never a row. A shard that overflows doubles and
is filled again from its stored digests.

Equal texts are equal after each run of ASCII white space becomes one space. Cases: null text is empty text; a
null key counts as larger than any other; of rows that repeat with the same key exactly one stays; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.scale import lookup_join
from ..session import materialise

SLOTS = 4
KICKS = 200
SHARD_KEYS = 50_000
FLUSH_KEYS = 500_000
SPACE = r"[\x20\x09-\x0D]+"


class CuckooIndex:
    """Live digests with a value each; ``merge`` joins the values of one digest."""

    def __init__(self, merge, buckets: int = 64):
        self.merge, self.size = merge, 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (SLOTS * buckets)
        self.keys: list[bytes | None] = [None] * (SLOTS * buckets)
        self.values: list = [None] * (SLOTS * buckets)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _find(self, key: bytes) -> int:
        mark, first, second = self._places(key)
        for bucket in (first, second):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.prints[slot] == mark and self.keys[slot] == key:  # verified against the stored digest
                    return slot
        return -1

    def __contains__(self, key: bytes) -> bool:
        return self._find(key) >= 0

    def get(self, key: bytes):
        return self.values[slot] if (slot := self._find(key)) >= 0 else None

    def insert(self, key: bytes, value) -> bool:
        """True if the digest is new."""
        slot = self._find(key)
        if slot >= 0:
            self.values[slot] = self.merge(self.values[slot], value)
            return False
        self._place(key, value)
        self.size += 1
        return True

    def _place(self, key: bytes, value) -> None:
        mark, bucket, second = self._places(key)
        for at in (bucket, second):
            for slot in range(SLOTS * at, SLOTS * at + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
                    return
        entry = (mark, key, value)
        for kick in range(KICKS):  # push an entry on to its other bucket
            slot = SLOTS * bucket + kick % SLOTS
            held = self.prints[slot], self.keys[slot], self.values[slot]
            self.prints[slot], self.keys[slot], self.values[slot] = entry
            entry = held
            bucket = self._other(bucket, entry[0])
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if not self.prints[slot]:
                    self.prints[slot], self.keys[slot], self.values[slot] = entry
                    return
        live = [*self.items(), entry[1:]]
        self._clear(2 * (self.mask + 1))
        for k, v in live:
            self._place(k, v)

    def delete(self, key: bytes) -> bool:
        slot = self._find(key)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values) if k is not None)


def digest(content: str):
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), SPACE, " "), 256))


def shard(digest_column: str, shards: int):
    return F.pmod(F.xxhash64(digest_column), F.lit(shards)).cast("int")


def _first(a: tuple, b: tuple) -> tuple:
    """Values are ((key is null, key, row), copies)."""
    return min(a[0], b[0]), a[1] + b[1]


def _emit(index: CuckooIndex, key_type: pa.DataType) -> pa.RecordBatch:
    items = list(index.items())
    return pa.RecordBatch.from_arrays([
        pa.array([k for k, _ in items], pa.binary()), pa.array([v[0][1] for _, v in items], key_type),
        pa.array([v[0][2] for _, v in items], pa.int64()), pa.array([v[1] for _, v in items], pa.int64()),
    ], names=["_digest", "_key", "_row", "_n"])


def _gather(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    index, kind = CuckooIndex(_first), None
    for batch in batches:
        kind = batch.column("_key").type
        columns = (batch.column(c).to_pylist() for c in ("_digest", "_key", "_row", "_n"))
        for d, k, r, n in zip(*columns):
            index.insert(d, ((k is None, k, r), n))
        if limit and index.size >= limit:
            yield _emit(index, kind)
            index = CuckooIndex(_first)
    if kind is not None:
        yield _emit(index, kind)


def live_digests(rows: DataFrame, shards: int) -> DataFrame:
    """(_digest, _key, _row, _n): per live digest its first row and its number of rows.

    Each task first gathers its own rows in a filter, so a text held by a third of all rows sends one row per
    task; then each shard gathers what the tasks found.
    """
    schema = rows.schema
    local = rows.mapInArrow(lambda batches: _gather(batches, FLUSH_KEYS), schema)
    dealt = local.withColumn("_shard", shard("_digest", shards))

    def one_shard(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_gather(iter(group.to_batches()), None)))

    return dealt.groupBy("_shard").applyInArrow(one_shard, schema)


def dedup(docs: DataFrame, key: str = "doc_id", content: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    rows = materialise(docs.select(
        digest(content).alias("_digest"), F.col(key).alias("_key"),
        F.monotonically_increasing_id().alias("_row"), F.lit(1).cast("long").alias("_n")), "digests")
    shards = max(1, -(-rows.count() // shard_keys))
    found = materialise(live_digests(rows, shards).filter(F.col("_n") > 1).select(
        "_digest", F.col("_key").alias("_keep"), F.col("_row").alias("_first"), F.col("_n").alias("_size")), "copies")
    joined = lookup_join(rows, found, "_digest", "_size", how="left")
    return joined.select(
        F.col("_key").alias(key),
        F.when(F.col("_first").isNull(), F.col("_key")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("_first", F.col("_row")) == F.col("_row")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


INDEX = "shard int, digest binary, live long"


def update_index(index: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """Apply insertions and deletions of documents to a stored index.

    ``changes`` has (digest, delta): +1 for a document that comes, -1 for one that goes. A digest stays live while
    documents hold it and leaves the filter with the last one; a deletion of an absent digest does nothing.
    Deltas of one digest are summed before they are shuffled. Returns (shard, digest, live).
    """
    spark = changes.sparkSession
    deltas = changes.groupBy("digest").agg(F.sum("delta").cast("long").alias("live")).select(
        shard("digest", shards).alias("shard"), "digest", "live")
    stored = spark.createDataFrame([], INDEX) if index is None else index.select("shard", "digest", "live")

    def merge(held: pa.Table, change: pa.Table) -> pa.Table:
        live = CuckooIndex(lambda a, b: a + b)
        for _, d, n in zip(*(held.column(c).to_pylist() for c in ("shard", "digest", "live"))):
            live.insert(d, n)
        number = (held if held.num_rows else change).column("shard")[0].as_py()
        for d, n in zip(*(change.column(c).to_pylist() for c in ("digest", "live"))):
            if n > 0:
                live.insert(d, n)
            elif n < 0 and (now := live.get(d)) is not None:
                live.insert(d, n) if now + n > 0 else live.delete(d)
        items = list(live.items())
        return pa.table([pa.array([number] * len(items), pa.int32()), pa.array([k for k, _ in items], pa.binary()),
                         pa.array([v for _, v in items], pa.int64())], names=["shard", "digest", "live"])

    return stored.groupBy("shard").cogroup(deltas.groupBy("shard")).applyInArrow(merge, INDEX)
