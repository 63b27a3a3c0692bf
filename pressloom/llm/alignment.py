"""Alignment of two tokenizers' tokens, and how often each pair of ids is linked in the whole corpus.

Each text gets a space before it and is encoded by a byte-level BPE (A) and a sentence-piece BPE (B). Tokens of A and B
are linked where their bytes overlap; byte offsets at which tokens of both end cut the text into groups. A pair's count
is the number of its links over all documents, and each document reports how many of its links are the best of their
B id and the sum of their counts.

1. The first pass aligns all documents; every task adds up the links of each pair it meets.
2. The distinct pairs are dealt into shards of about ``SHARD`` keys, and each shard's minimal perfect hash is built in a
   task of its own (``perfect_hash``).
3. Partial counts become dense vectors indexed by hash; the vectors of a shard are summed up a tree of ``ARITY`` at a time.
4. The second pass aligns all documents again and looks the counts up; a slot's key is compared, so no other pair's count
   is ever taken. Up to ``broadcast_bytes`` the hashed counts go to all tasks. Beyond that the documents' pairs are dealt
   to the shards, hot shards over several tasks, and the sums come back by row; both ways give the same rows.

Both tokenizers start anew at a space before an ASCII letter, unless another space stands before it, so a text is cut
there and each distinct piece is aligned once per worker (checked on B's vocabulary: no piece goes on after a space
inside). A text with B's own space mark is never cut.

Cases: null and empty texts, and texts whose tokens do not spell them (say, with U+2581), have no tokens: zeros and an
empty digest. Texts of any length are aligned whole. Null and repeated keys keep their rows; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialise
from .perfect_hash import BUCKET_BITS, PerfectHash, Shard, buckets, build
from .words import texts_of

SHARD = 1 << 15
ARITY = 16
BROADCAST_BYTES = 64 << 20
CACHE_BYTES = 96 << 20
JOINED = 1 << 17  # bytes of pieces encoded in one call
# Fixed value: where a byte-level BPE parts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FLUSH_PAIRS = 1 << 20
MARK = "▁"
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies print for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, vocabulary = _byte_level(a_path)
        letters = byte_letters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # each id as printed within and at the end of its side of a group
        self.printed = [str(i).encode() + end for ids, ends in ((len(self.a_bytes), b",|"), (len(self.b_bytes), b",;"))
                        for end in (ends[:1], ends[1:]) for i in range(ids)]

    def pieces(self, data: bytes) -> list[bytes]:
        """A text with its leading space, cut where both tokenizers start anew."""
        if not self.cuts or MARK.encode() in data:
            return [data]
        a = np.frombuffer(data, np.uint8)
        starts = (np.flatnonzero((a[1:-1] == 32) & LETTER[a[2:]] & (a[:-2] != 32)) + 1).tolist()
        return [data[s:e] for s, e in zip([0, *starts], [*starts, len(data)])]

    def joins(self, piece: bytes) -> bool:
        """Whether a piece may stand among others and is still cut out of them."""
        return self.cuts and len(piece) > 1 and bool(LETTER[piece[1]]) and piece[-1] != 32 and MARK.encode() not in piece

    def align(self, pieces: list[bytes], printing: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]] | None:
        """Of pieces one after the other: (tokens of A, of B, groups and links of each; all links; each one's printed groups,
        which are left out without ``printing``).

        None if the tokens do not spell the pieces. Between two neighbouring token ends, of A or B, lies exactly one
        link: no two tokens overlap in two places.
        """
        data = b"".join(pieces)
        text = data.decode()
        a, b = np.array(self.a(text), np.int64), np.array(self.b.encode(text[1:]), np.int64)
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != data or b"".join([self.b_bytes[i] for i in b.tolist()]) != data:
            return None
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        borders = np.cumsum([len(p) for p in pieces])
        ends = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")
        again = np.append(False, ends[1:] == ends[:-1])
        every, both = ends[~again], ends[again]
        sizes = np.stack([np.diff(np.searchsorted(x, borders, "right"), prepend=0) for x in (a_ends, b_ends, both, every)], 1)
        links = b[np.searchsorted(b_ends, every)].astype(np.uint64) << np.uint64(32) | a[np.searchsorted(a_ends, every)].astype(np.uint64)
        if not printing:
            return sizes, links, []
        # both sides' ids in order of group and side
        groups = np.concatenate([2 * np.searchsorted(both, a_ends), 2 * np.searchsorted(both, b_ends) + 1])
        order = np.argsort(groups, kind="stable")
        groups = groups[order]
        last = np.append(groups[1:] != groups[:-1], True)
        side = np.concatenate([a, b + 2 * len(self.a_bytes)])[order]
        printed = [self.printed[i] for i in (side + last * np.where(groups & 1, len(self.b_bytes), len(self.a_bytes))).tolist()]
        ends = np.cumsum(sizes[:, 0] + sizes[:, 1]).tolist()
        return sizes, links, [b"".join(printed[s:e])[:-1] for s, e in zip([0, *ends], ends)]


def _byte_level(path: str) -> tuple[Callable[[str], list[int]], dict[str, int]]:
    """(encoder, vocabulary without added tokens) of a byte-level BPE.

    Where ids follow the order of the merges, ranks alone give the same tokens, and a faster encoder takes them.
    """
    import json

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    vocabulary = whole.get_vocab(with_added_tokens=False)
    stored = json.loads(whole.to_str())
    before = stored["pre_tokenizer"] or {}
    merged = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in stored["model"]["merges"]]
    plain = stored["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not (plain and merged == sorted(merged)):
        return lambda text: whole.encode(text, add_special_tokens=False).ids, vocabulary
    import tiktoken

    letters = byte_letters()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items()}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, vocabulary


class Lexicon:
    """Aligned pieces by number: sizes, links in one array, printed groups. Forgotten when it outgrows its bytes."""

    def __init__(self, pair: Pair, printing: bool = True):
        self.pair, self.printing = pair, printing
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.printed: list[bytes] = []
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links; links are -1 where the bytes differ
        self.ends = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.uint64)
        self.held = 0

    def full(self) -> bool:
        return self.held > CACHE_BYTES

    def _learn(self, inner: list[bytes], outer: list[bytes]) -> None:
        """Align new pieces, all that join together; pieces from inside a text always do."""
        alone = [p for p in outer if not self.pair.joins(p)]
        lists = [[p] for p in alone] + list(_groups(inner + [p for p in outer if self.pair.joins(p)], JOINED))
        sizes, links = [self.sizes], [self.links]
        while lists:
            some = lists.pop()
            aligned = self.pair.align(some, self.printing)
            if aligned is None and len(some) > 1:
                lists += [[p] for p in some]
                continue
            size, link, printed = aligned or (np.array([[0, 0, 0, -1]]), np.zeros(0, np.uint64), [b""])
            self.rows.update(zip(some, range(len(self.rows), len(self.rows) + len(some))))
            self.printed += printed
            sizes.append(size)
            links.append(link)
            self.held += 150 * len(some) + sum(map(len, some)) + sum(map(len, printed)) + 8 * len(link)
        self.sizes, self.links = np.concatenate(sizes), np.concatenate(links)
        self.ends = np.concatenate(([0], np.cumsum(np.maximum(self.sizes[:, 3], 0))))

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """Piece numbers of each text; none for an empty one."""
        cut = [self.pair.pieces(b" " + t) if t else [] for t in texts]
        rows = self.rows
        outer = {p: None for pieces in cut for p in pieces[:1] + pieces[-1:] if p not in rows}
        inner = {p: None for pieces in cut for p in pieces[1:-1] if p not in rows and p not in outer}
        if outer or inner:
            self._learn(list(inner), list(outer))
        return [np.fromiter(map(rows.__getitem__, pieces), np.int64, len(pieces)) for pieces in cut]


_pairs: dict[tuple[str, str], Pair] = {}


def _lexicon(a_path: str, b_path: str, printing: bool = True) -> Lexicon:
    """Tokenizers are loaded once per Python worker; the aligned pieces are a task's own."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return Lexicon(_pairs[a_path, b_path], printing)


def _groups(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about ``limit`` bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, numbers = keys[order], numbers[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(numbers, first) if len(keys) else numbers


def pair_counts(docs: DataFrame, a_path: str, b_path: str, content: str) -> DataFrame:
    """First pass: (bucket, pair, n), each task's own sums; a pair is B's id above A's, 32 bits each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen = _lexicon(a_path, b_path, printing=False), np.zeros(0, np.int64)
        keys, numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def taken():
            per_link = np.repeat(seen, np.maximum(lexicon.sizes[: len(seen), 3], 0))
            some = per_link > 0
            return _summed(np.concatenate((keys, lexicon.links[: len(per_link)][some])), np.concatenate((numbers, per_link[some])))

        for batch in batches:
            for texts in _groups(texts_of(batch.column(0))):
                spelt = [n for n in lexicon.numbers(texts) if len(n) and lexicon.sizes[n, 3].min() > 0]
                seen = np.concatenate((seen, np.zeros(len(lexicon.sizes) - len(seen), np.int64)))
                if spelt:
                    seen += np.bincount(np.concatenate(spelt), minlength=len(seen))
                if lexicon.full():
                    keys, numbers = taken()
                    lexicon.clear()
                    seen = seen[:0]
                    if len(keys) > FLUSH_PAIRS:
                        yield _pair_rows(keys, numbers)
                        keys, numbers = keys[:0], numbers[:0]
        yield _pair_rows(*taken())

    return docs.select(content).mapInArrow(run, "bucket long, pair long, n long")


def _pair_rows(keys: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets(keys)), pa.array(keys.astype(np.int64)), pa.array(numbers, pa.int64())],
                                      names=["bucket", "pair", "n"])


def _shard(shards: int):
    return F.shiftright(F.col("bucket") * shards, BUCKET_BITS).cast("int")


def hashed(distinct: DataFrame, shards: int) -> DataFrame:
    """(shard, sizes, words, keys): the perfect hash of each shard of (bucket, pair) rows."""
    def run(table: pa.Table) -> pa.Table:
        made = build(table.column("pair").to_numpy().astype(np.uint64))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                         **{name: pa.array([value.tobytes()], pa.binary()) for name, value in made._asdict().items()}})

    return distinct.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(
        run, "shard int, sizes binary, words binary, keys binary")


def _function(row: dict) -> PerfectHash:
    return PerfectHash([Shard(*(np.frombuffer(row[name], kind) for name, kind in (("sizes", np.int64), ("words", np.uint64), ("keys", np.uint64))))])


def _slots(function: PerfectHash, pairs: np.ndarray) -> np.ndarray:
    """Slots within a single shard, whose keys are all members."""
    pairs = pairs.astype(np.uint64)
    slots = function.slots(pairs, np.zeros(len(pairs), np.int64))
    if len(slots) and not (slots.min() >= 0 and (function.keys[slots] == pairs).all()):
        raise ValueError("a pair without a place in its shard")
    return slots


def _dealt(functions: DataFrame, branches: int) -> DataFrame:
    """Each shard's row once per branch."""
    return functions.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))


def dense_counts(partial: DataFrame, functions: DataFrame, shards: int, branches: int) -> DataFrame:
    """(shard, counts): the dense count vector of each shard, summed up a tree over the branches."""
    def fill(rows: pa.Table, function: pa.Table) -> pa.Table:
        made = _function(function.to_pylist()[0])
        counts = np.zeros(len(made.keys), np.int64)
        np.add.at(counts, _slots(made, rows.column("pair").to_numpy()), rows.column("n").to_numpy())
        return vector(function, counts)

    def vector(keyed: pa.Table, counts: np.ndarray) -> pa.Table:
        return pa.table({"shard": keyed.column("shard").slice(0, 1), "branch": keyed.column("branch").slice(0, 1),
                         "counts": pa.array([counts.tobytes()], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        return vector(rows, sum(np.frombuffer(v, np.int64) for v in rows.column("counts").to_pylist()))

    schema = "shard int, branch int, counts binary"
    placed = partial.select(_shard(shards).alias("shard"), F.pmod(F.xxhash64("task"), F.lit(branches)).cast("int").alias("branch"), "pair", "n")
    vectors = placed.groupBy("shard", "branch").cogroup(_dealt(functions, branches).groupBy("shard", "branch")).applyInArrow(fill, schema)
    while branches > 1:
        vectors = vectors.withColumn("branch", (F.col("branch") / ARITY).cast("int")).groupBy("shard", "branch").applyInArrow(add, schema)
        branches = -(-branches // ARITY)
    return vectors.drop("branch")


def best_counts(model: DataFrame) -> DataFrame:
    """(b, best): the highest count of each B id, at most one row per id of its vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                b = (np.frombuffer(keys, np.uint64) >> np.uint64(32)).astype(np.int64)
                counts = np.frombuffer(counts, np.int64)
                best = np.zeros(b.max(initial=0) + 1, np.int64)
                np.maximum.at(best, b, counts)
                ids = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best[ids])], names=["b", "best"])

    return model.select("keys", "counts").mapInArrow(run, "b long, best long").groupBy("b").agg(F.max("best").alias("best"))


def learn(docs: DataFrame, a_path: str, b_path: str, content: str = "text") -> tuple[DataFrame, int]:
    """(shard, sizes, words, keys, counts) rows of the corpus, and the number of distinct pairs."""
    partial = materialise(pair_counts(docs, a_path, b_path, content).withColumn("task", F.spark_partition_id()), "pairs")
    distinct = materialise(partial.select("bucket", "pair").distinct(), "pairs_distinct")
    n, rows = distinct.count(), partial.count()
    shards = min(1 << BUCKET_BITS, max(1, -(-n // SHARD)))
    functions = materialise(hashed(distinct, shards), "pair_hash")
    # a branch of a shard gets about eight rows per key
    branches = max(1, rows // (8 * max(1, n)))
    model = functions.join(dense_counts(partial, functions, shards, branches), "shard")
    return materialise(model, "pair_model"), n


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of runs of rows."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)))
    return total[bounds[1:]] - total[bounds[:-1]]


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", content: str = "text",
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    model, n = learn(docs, a_path, b_path, content)
    best = np.zeros(1 << 16, np.int64)
    for r in best_counts(model).collect():  # at most one row per id of B
        if r["b"] >= len(best):
            best = np.concatenate((best, np.zeros(r["b"], np.int64)))
        best[r["b"]] = r["best"]
    # a key, a count and about four bits a pair
    small = 20 * n <= broadcast_bytes
    if small:
        rows = [r.asDict() for r in model.orderBy("shard").collect()]
        functions = PerfectHash([Shard(np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["words"], np.uint64), np.frombuffer(r["keys"], np.uint64))
                                 for r in rows])
        counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        known = spark.sparkContext.broadcast((functions, counts, best))
    tail = [] if small else [T.StructField("_pairs", T.ArrayType(T.LongType())), T.StructField("_times", T.ArrayType(T.LongType()))]
    out = T.StructType([T.StructField("_key", docs.schema[key].dataType)] + [T.StructField(c, T.LongType()) for c in COUNTS]
                       + [T.StructField("groups_sha256", T.StringType())] + tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(a_path, b_path)
        scores = np.zeros((0, 2), np.int64)  # best links and sum of counts of each piece
        for batch in batches:
            sums, digests, pairs, times = [np.zeros((0, 6), np.int64)], [], [], []
            for texts in _groups(texts_of(batch.column("_text"))):
                numbers = lexicon.numbers(texts)
                spelt = [n if len(n) and lexicon.sizes[n, 3].min() > 0 else n[:0] for n in numbers]
                if small and len(scores) < len(lexicon.sizes):
                    functions, counts, best = known.value
                    links = lexicon.links[lexicon.ends[len(scores)] :]
                    slots = functions.members(links)
                    # pieces of texts that do not spell out may hold pairs that nothing counted
                    own = np.where(slots >= 0, counts[slots], 0) if len(counts) else np.zeros(len(links), np.int64)
                    is_best = (own == best[(links >> np.uint64(32)).astype(np.int64)]) & (own > 0)
                    bounds = lexicon.ends[len(scores) :] - lexicon.ends[len(scores)]
                    scores = np.concatenate((scores, _sums(np.stack((is_best.astype(np.int64), own), 1), bounds)))
                bounds = np.concatenate(([0], np.cumsum([len(n) for n in spelt])))
                every = np.concatenate(spelt) if spelt else np.zeros(0, np.int64)
                extra = scores[every] if small else np.zeros((len(every), 2), np.int64)
                sums.append(_sums(np.concatenate((lexicon.sizes[every], extra), 1), bounds))
                for n in spelt:
                    printed = lexicon.printed
                    digests.append(hashlib.sha256(b";".join([printed[i] for i in n.tolist()])).hexdigest() if len(n) else "")
                    if not small:
                        links = [lexicon.links[lexicon.ends[i] : lexicon.ends[i + 1]] for i in n.tolist()]
                        keys, often = np.unique(np.concatenate(links) if links else np.zeros(0, np.uint64), return_counts=True)
                        pairs.append(keys.astype(np.int64))
                        times.append(often.astype(np.int64))
                if lexicon.full():
                    lexicon.clear()
                    scores = scores[:0]
            columns = [batch.column("_key"), *(pa.array(c) for c in np.concatenate(sums).T), pa.array(digests, pa.string())]
            if not small:
                columns += [pa.array(c, pa.list_(pa.int64())) for c in (pairs, times)]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    aligned = docs.select(F.col(key).alias("_key"), F.col(content).alias("_text")).mapInArrow(run, out)
    if not small:
        aligned = _by_shard(materialise(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned"), model, n, best)
    return aligned.select(F.col("_key").alias(key), *COUNTS, "groups_sha256")


def _by_shard(aligned: DataFrame, model: DataFrame, n: int, best: np.ndarray) -> DataFrame:
    """Best links and sums of counts of each row, its pairs looked up where their shard is."""
    spark = aligned.sparkSession
    bests = spark.sparkContext.broadcast(best)
    shards = min(1 << BUCKET_BITS, max(1, -(-n // SHARD)))
    links = aligned.agg(F.sum(F.size("_pairs"))).first()[0] or 0
    branches = max(1, links // (shards << 20))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(buckets(batch.column("pair").to_numpy().astype(np.uint64)))],
                                             names=["_row", "pair", "times", "bucket"])

    def look(rows: pa.Table, function: pa.Table) -> pa.Table:
        held = function.to_pylist()[0]
        counts = np.frombuffer(held["counts"], np.int64)
        pairs, times = rows.column("pair").to_numpy(), rows.column("times").to_numpy()
        own = counts[_slots(_function(held), pairs)] if len(pairs) else np.zeros(0, np.int64)
        order = np.argsort(rows.column("_row").to_numpy(), kind="stable")
        who = rows.column("_row").to_numpy()[order]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
        top = np.where(own == bests.value[pairs >> 32], times, 0)[order]
        sums = [np.add.reduceat(v, first) if len(first) else v[:0] for v in (top, (own * times)[order])]
        return pa.table({"_row": who[first], "n_best": sums[0], "count_sum": sums[1]})

    exploded = aligned.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("p")).select(
        "_row", F.col("p._pairs").alias("pair"), F.col("p._times").alias("times"))
    placed = exploded.mapInArrow(place, "_row long, pair long, times long, bucket long").select(
        _shard(shards).alias("shard"), F.pmod(F.xxhash64("_row"), F.lit(branches)).cast("int").alias("branch"), "_row", "pair", "times")
    found = placed.groupBy("shard", "branch").cogroup(_dealt(model, branches).groupBy("shard", "branch")).applyInArrow(
        look, "_row long, n_best long, count_sum long")
    sums = found.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = aligned.drop("_pairs", "_times", "n_best", "count_sum").join(sums, "_row", "left")
    return joined.fillna(0, ["n_best", "count_sum"]).drop("_row")
