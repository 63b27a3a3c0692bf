"""Similarity self-join on word shingles by parity sketches.

A text's set of shingles is XOR-hashed into bits: every shingle flips one bit, so the Hamming distance of two
sketches never exceeds the size of the symmetric difference of the sets. At similarity t two sets of sizes a and
b differ in at most D = (a + b)(1 - t)/(1 + t) shingles, and a set of n shingles differs from any partner in at most
n(1 - t)/t. Within a band of sizes the sketch is cut into P parts, more than D; sets that link agree in at least
P - D of them. The parts are the join keys. A part has so many bits that two of them agree by chance as good as never,
so what is found in a part does not grow with the number of texts; it is kept as a hash of its set bits.

Most parts of most texts stand nowhere else. They are counted first, and a text leaves a band if fewer than P - D of
its parts are found in other texts. This is done once more among the texts that are left. Of the rest, each is listed
under the D + 1 rarest of its parts only: in one order of all parts, two texts that link have their first common part
among the first D + 1 of each, as at most D parts come before it. Parts without a shingle come last in that order, so
a text lists them only if it has no more than D others. Nothing is lost, and a passage that many texts share is
hardly ever a key.

Texts with equal sets are one class. Within a key no pairs are formed at first: every member is checked against
the member that shares most (large groups of near copies collapse onto it), links are merged into components, and
only members of one key that are still in different components are paired, behind the Hamming bound of their whole
sketches. All candidates are verified on their shingle sets, so links are exact.

Cases: null and empty texts have an empty set and link with nothing; a text of fewer words than a shingle is one
shingle; rows that repeat form one class; a null key takes part in no link (its component is null); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..operators.scale import lookup_join, salted_join
from ..session import materialise, scratch
from . import words
from .components import components

BAND_RATIO = 1.5
SLACK = 1.35  # parts for each one that may differ
PART_BITS = 40  # a part is a sketch of 2^40 bits, of which few are set
SKETCH_WORDS = 32  # longs of the whole sketch that guards pairs
GLANCE = 64  # one listed row in so many is looked at to find hot buckets
HOT = 10_000  # most buckets whose rows are dealt out
FOLD_WORDS = 8  # longs of the same sketch folded, for pairs within a bucket


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for some in words.groups(texts):
        hashes, bounds = words.word_hashes(texts[some])
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if e - s >= k:
                yield np.unique(words.ngrams(hashes[s:e], k))
            elif e > s:
                yield words.ngrams(hashes[s:e], e - s) + np.uint64(e - s)
            else:
                yield hashes[:0]


class Bands:
    """Size bands, their numbers of parts and the keys of a set in each band in which it can link."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]

    def _reach(self, n: int) -> None:
        while self.low[-1] <= 2 * n + 2:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * BAND_RATIO)))

    def differences(self, a: int, b: int) -> int:
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> list[int]:
        self._reach(n)
        first = bisect_right(self.low, n) - 1
        last = first
        while 100 * n >= self.percent * self.low[last + 1]:
            last += 1
            self._reach(self.low[last])
        return list(range(first, last + 1))

    def keys(self, shingles: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each band: its number with the least number of listed parts that any partner shares, and their keys.

        Parts without a shingle are not listed, and the count leaves them out. A text with too few other parts lists
        all it has, and one of them is all that can be asked for: its partner may not list the parts without a shingle.
        """
        found, n = [], len(shingles)
        for band in self.of(n):
            most = self.differences(self.low[band + 1] - 1, self.low[band + 1] - 1)
            parts = int((most + 1) * SLACK) + 2 if most else 1
            own = min(most, n * (100 - self.percent) // self.percent)
            part = (shingles % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.diff(part[order], prepend=-1))
            held = part[order][first]
            # the set bits of a part as the XOR of their numbers' hashes: a bit that is flipped twice cancels out
            bits = np.zeros(parts, np.uint64)
            bits[held] = np.bitwise_xor.reduceat(words.mixed(shingles >> np.uint64(64 - PART_BITS))[order], first)
            listed, need = (held, len(held) - own) if len(held) > own else (np.arange(parts), 1)
            key = words.mixed(np.uint64(band << 40) + listed.astype(np.uint64))
            found.append((band << 32 | need, words.mixed(key * np.uint64(words.BASE) + bits[listed])))
        return found


def whole_sketch(shingles: np.ndarray) -> np.ndarray:
    bits = (words.mixed(shingles) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    flips = np.bincount(bits, minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(key, size, set_id, slots, sketch) for each row of (key, text); a slot is a band with its least count and keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, ids, keys, ends, prints = [], [], [], [0], []
                for s in shingle_sets(words.texts_of(batch.column("text")), k):
                    sizes.append(len(s))
                    two = words.mixed(s + np.uint64(len(s))).sum(dtype=np.uint64), np.bitwise_xor.reduce(words.mixed(s * np.uint64(5)))
                    ids.append(np.array(two, np.uint64).tobytes())
                    keys += bands.keys(s) if len(s) else []
                    ends.append(len(keys))
                    prints.append(whole_sketch(s))
                slots = pa.StructArray.from_arrays([pa.array([b for b, _ in keys], pa.int64()), _lists([x for _, x in keys])],
                                                   names=["slot", "buckets"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), slots), _lists(prints)],
                    names=["key", "size", "set_id", "slots", "sketch"])

    longs = T.ArrayType(T.LongType())
    out = T.StructType([docs.schema["key"], T.StructField("size", T.LongType()), T.StructField("set_id", T.BinaryType()),
                        T.StructField("slots", T.ArrayType(T.StructType([T.StructField("slot", T.LongType()), T.StructField("buckets", longs)]))),
                        T.StructField("sketch", longs)])
    return docs.mapInArrow(run, out)


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = _lists(list(shingle_sets(words.texts_of(batch.column("text")), k)))
                yield pa.RecordBatch.from_arrays([batch.column("key"), sets], names=["key", "shingles"])

    return docs.mapInArrow(run, T.StructType([docs.schema["key"], T.StructField("shingles", T.ArrayType(T.LongType()))]))


def _near(x: str, y: str, percent: int, longs: int = SKETCH_WORDS) -> Column:
    """What sizes and sketches allow: a pair that fails this cannot link."""
    a, b = F.col(f"{x}.size"), F.col(f"{y}.size")
    far = F.lit(0)
    for i in range(longs):
        far = far + F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i]))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * far <= (100 - percent) * (a + b))


def _folded(sketch: str) -> Column:
    """The sketch over fewer bits: words that fall together are XORed."""
    def word(i: int) -> Column:
        out = F.col(sketch)[i]
        for j in range(i + FOLD_WORDS, SKETCH_WORDS, FOLD_WORDS):
            out = out.bitwiseXOR(F.col(sketch)[j])
        return out
    return F.array(*(word(i) for i in range(FOLD_WORDS)))


def _possible(pairs: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches allow; many pairs may share one b."""
    print_ = F.struct("size", "sketch")
    left = pairs.join(prints.select(F.col("key").alias("a"), print_.alias("_p")), "a")
    both = salted_join(left, prints.select(F.col("key").alias("b"), print_.alias("_q")), "b", "a")
    return both.filter(_near("_p", "_q", percent)).select("a", "b")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the similarity; many pairs may share one b."""
    left = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("_x")), "a")
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("_y"))
    both = salted_join(left, right, "b", "a", per_task=1000)
    shared = F.size(F.array_intersect("_x", "_y"))
    return both.filter(100 * shared >= percent * (F.size("_x") + F.size("_y") - shared)).select("a", "b")


def _sets_for(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    needed = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    rows = lookup_join(docs, materialise(needed, "needed"), "key").dropDuplicates(["key"])
    return materialise(sets_of(rows, k), "sets")


def _able(listed: DataFrame) -> DataFrame:
    """Rows (key, slot, bucket, n) of the texts that share as many parts as their slot asks for.

    n counts the texts of a bucket. All rows meet by bucket once, in a window. Buckets that hold a visible share of
    all rows are told by one row in ``GLANCE``, at most ``HOT`` of them by counting; their rows are dealt out and take
    the estimate from there, which only orders parts: any bucket seen twice has two members for certain.
    """
    seen = listed.filter(F.pmod(F.xxhash64("key", "bucket"), F.lit(GLANCE)) == 0).groupBy("bucket").agg(F.count(F.lit(1)).alias("_seen"))
    seen = materialise(seen.filter("_seen > 1"), "seen")
    total = seen.agg(F.sum("_seen")).first()[0] or 0
    hot = seen.filter(F.col("_seen") * HOT >= F.lit(total))
    dealt = listed.join(F.broadcast(hot), "bucket", "left").withColumn(
        "_deal", F.when(F.col("_seen").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(1024))).otherwise(F.lit(0)))
    met = dealt.withColumn("n", F.coalesce(F.col("_seen") * GLANCE, F.count(F.lit(1)).over(W.partitionBy("bucket", "_deal"))))
    met = met.filter("n > 1").select("key", "slot", "bucket", "n")
    # a window over one text's parts in one band
    counted = met.withColumn("_found", F.count(F.lit(1)).over(W.partitionBy("key", "slot")))
    return counted.filter(F.col("_found") >= _need())


def _need() -> Column:
    return F.col("slot").bitwiseAND(F.lit((1 << 32) - 1))


def _members(listed: DataFrame) -> DataFrame:
    """(key, bucket, n) of the rarest parts, as many as a text must be listed under."""
    once = materialise(_able(listed).select("key", "slot", "bucket"), "able")
    rarest = W.partitionBy("key", "slot").orderBy("n", "bucket")
    found = _able(once).withColumn("_at", F.row_number().over(rarest))
    return found.filter(F.col("_at") <= F.col("_found") - _need() + 1).select("key", "bucket", "n")


def link(docs: DataFrame, key: str = "doc_id", content: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (the least key reachable by links)."""
    with scratch(docs.sparkSession):
        return materialise(_linked(docs.select(F.col(key).alias("key"), F.col(content).alias("text")), k, percent).select(
            F.col("key").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component", "_class").alias("component_id")),
            "linked", keep=True)


def _linked(texts: DataFrame, k: int, percent: int) -> DataFrame:
    rows = materialise(sketches(texts, k, percent), "sketches")
    able = rows.filter((F.col("size") > 0) & F.col("key").isNotNull())
    copies = materialise(able.groupBy("set_id").agg(F.min("key").alias("_class"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "copies")
    classes = lookup_join(able, copies, "set_id", "_n", how="left").filter(
        F.coalesce("_class", "key") == F.col("key")).drop("_class", "_n")
    listed = classes.select("key", F.explode("slots").alias("s")).select("key", "s.slot", F.explode("s.buckets").alias("bucket"))
    members = materialise(_members(listed), "members")
    # the member that shares most leads its bucket
    fame = members.groupBy("key").agg(F.sum("n").alias("fame"))
    rank = F.struct("fame", -F.col("key"))
    leaders = materialise(members.join(fame, "key").groupBy("bucket").agg(
        (-F.max(rank)["col2"]).alias("b"), F.count(F.lit(1)).alias("n")), "leaders")
    spokes = materialise(lookup_join(members.select("bucket", F.col("key").alias("a")), leaders, "bucket", "n").filter("a != b"), "spokes")
    stars = materialise(spokes.select("a", "b").distinct(), "stars")
    prints = classes.select("key", "size", "sketch").dropDuplicates(["key"])
    near = materialise(_possible(stars, prints, percent), "near")
    links = materialise(_links(near, _sets_for(near, texts, k), percent), "links")
    merged = components(links)
    # members of one bucket, its leader aside, that are in different components still
    label = F.coalesce("component", "key").alias("label")
    # (where all are linked with the leader, none is)
    loose = spokes.filter("n > 2").join(links, ["a", "b"], "left_anti").select("bucket", "n").distinct()
    loose = materialise(loose, "loose")
    labelled = lookup_join(spokes.select("bucket", F.col("a").alias("key")), loose, "bucket", "n").select("bucket", "key").join(
        merged.withColumnRenamed("id", "key"), "key", "left").select("bucket", "key", label)
    split = labelled.groupBy("bucket").agg(F.min("label").alias("_a"), F.max("label").alias("_b"), F.count(F.lit(1)).alias("n"))
    split = materialise(split.filter("_a < _b").select("bucket", "n"), "split")
    open_ = lookup_join(labelled, split, "bucket", "n").drop("n").join(
        prints.select("key", "size", _folded("sketch").alias("sketch")), "key")
    x, y = open_.alias("x"), open_.alias("y")
    apart = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.key") < F.col("y.key"))
                   & (F.col("x.label") != F.col("y.label")) & _near("x", "y", percent, FOLD_WORDS))
    apart = apart.select(F.col("y.key").alias("a"), F.col("x.key").alias("b")).distinct()
    apart = apart.join(stars.union(stars.select("b", "a")), ["a", "b"], "left_anti")
    apart = materialise(_possible(materialise(apart, "apart"), prints, percent), "apart")
    if not apart.isEmpty():
        more = materialise(_links(apart, _sets_for(apart, texts, k), percent), "links")
        if not more.isEmpty():
            merged = components(links.union(more))
    weighed = merged.withColumnRenamed("id", "_class").join(copies.select("_class", "_n"), "_class", "left").withColumn(
        "_n", F.coalesce("_n", F.lit(1)))
    classed = lookup_join(rows.select("key", "size", "set_id"), copies, "set_id", "_n", how="left").withColumn(
        "_class", F.when(F.col("key").isNotNull(), F.coalesce("_class", "key"))).drop("_n")
    return lookup_join(classed, materialise(weighed, "components"), "_class", "_n", how="left")


def keep_one(docs: DataFrame, key: str = "doc_id", content: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that reach a lesser key by links; rows with a null key stay, as do rows that
    repeat a key that stays."""
    with scratch(docs.sparkSession):
        linked = link(docs, key, content, k, percent)
        gone = materialise(linked.filter(F.col("component_id") != F.col(key)).select(key).distinct(), "gone", keep=True)
    return lookup_join(docs, gone, key, how="left_anti").select(*docs.columns)
