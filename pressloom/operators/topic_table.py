"""Topics whose term matrix is a table: variational Bayes for LDA over a vocabulary of any size.

Documents are placed once, by a hash of their key, in blocks of a bounded number of (document, term) entries; a block is
stored with its own numbering of its terms, which are divided into parts by a hash, some blocks to a part. A round
gives every block the topic weights of its own terms, works out each document's topic shares from them, and sums the
expected counts back per part. What moves in a round is a row per block and part, with the numbers of the terms they share
in one piece. Only the topics' totals, one number each, meet the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialise, release, scratch, setting
from .scale import lookup_join

INNER, CLOSE = 100, 1e-3
# Entries of a block, on average, and the least for more blocks than needed; cells that are worked on at once.
BLOCK_ENTRIES, LEAST_ENTRIES, CELLS = 4_000_000, 100_000, 80_000
# Documents that are done are set aside when so many of a batch are; the steps after which batches are first made anew.
SET_ASIDE, SPAN = 0.2, 32

# Rows of a term are small, and a bound on a batch's bytes, beside that on its rows, would weigh the batch again for each row.
BATCH, ANY = "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1)


class TopicTable(NamedTuple):
    """``terms``: (term, df, weights), the variational weights of the topics; ``totals``: their sums over all terms.
    ``counts``, ``blocks``, ``state`` and ``number``: what the fit has read, its blocks, their weights and how many there may
    be, for shares of the same rows."""

    terms: DataFrame
    totals: list[float]
    alpha: float
    inner: int | None = INNER
    counts: DataFrame | None = None
    blocks: DataFrame | None = None
    state: DataFrame | None = None
    number: int = 0


def digamma(x: np.ndarray) -> np.ndarray:
    """Logarithmic derivative of the gamma function for positive x: six steps up, then its asymptotic series."""
    x = np.asarray(x, float)
    # 1/x + 1/(x+5), 1/(x+1) + 1/(x+4) and 1/(x+2) + 1/(x+3) have one numerator
    pairs = x * (x + 5)
    shift = (2 * x + 5) * (1 / pairs + 1 / (pairs + 4) + 1 / (pairs + 6))
    x = x + 6
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - shift


def _theta(gamma: np.ndarray) -> np.ndarray:
    found = digamma(np.concatenate([gamma, gamma.sum(1, keepdims=True)], 1))
    return np.exp(found[:, :-1] - found[:, -1:])


def _per_word(theta: np.ndarray, beta: np.ndarray, counts: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Counts over the weights of their terms, in ``out``: (documents, 1, terms)."""
    found = np.matmul(theta[:, None, :], beta, out=out)[:, 0, :]
    found += 1e-100
    return np.divide(counts, found, out=found)


def _steps(beta: np.ndarray, counts: np.ndarray, gamma: np.ndarray, alpha: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(topic weights, whether more steps are needed) of documents x topics x terms of equal width after up to ``most`` steps;
    a count of zero fills up. Each document ends with its own last step, whatever the others do."""
    size, _, width = beta.shape
    found, room = gamma.copy(), np.empty((size, 1, width))
    open_, b, c, going = np.arange(size), beta, counts, np.ones(size, bool)
    for _ in range(most):
        theta = _theta(gamma)
        per_word = _per_word(theta, b, c, room[:len(b)])
        before, gamma = gamma, alpha + theta * np.matmul(b, per_word[:, :, None])[:, :, 0]
        done = going & (np.abs(gamma - before).mean(1) < CLOSE)
        if done.any():
            found[open_[done]] = gamma[done]
            going &= ~done
            left = np.count_nonzero(going)
            if not left:
                break
            # those that are done go on unread until it pays to copy the others
            if left <= (1 - SET_ASIDE) * len(going):
                open_, b, c, gamma, going = open_[going], b[going], c[going], gamma[going], np.ones(left, bool)
    found[open_[going]] = gamma[going]
    more = np.zeros(size, bool)
    more[open_[going]] = True
    return found, more


def document_topics(beta: np.ndarray, counts: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(variational topic weights of a document, expected counts per term and topic) from its terms' exp E[log beta]."""
    gamma, found = block_topics(beta, np.array([len(beta)]), np.arange(len(beta)), counts, alpha)
    return gamma[0], found


def _batches(documents: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Documents, those of like length together, up to ``CELLS`` cells at once."""
    order = documents[np.argsort(sizes[documents], kind="stable")]
    at = 0
    while at < len(order):
        widths = sizes[order[at:at + CELLS]]
        cells = widths * np.arange(1, len(widths) + 1)  # they never fall
        end = at + max(1, int(np.searchsorted(cells, CELLS, "right")))
        yield order[at:end]
        at = end


def block_topics(beta: np.ndarray, ends: np.ndarray, at: np.ndarray, n: np.ndarray, alpha: float,
                 inner: int | None = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(topic weights per document, expected counts per term) of documents whose entries end at ``ends``: term numbers
    ``at`` and counts ``n``. A document without entries keeps zeros."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    by_topic = np.ascontiguousarray(beta.T)
    topics, size = by_topic.shape
    has = np.flatnonzero(sizes)
    gamma, sums = np.zeros((len(ends), topics)), np.zeros((topics, size))

    def together(documents: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for docs in _batches(documents, sizes):
            inside = np.arange(sizes[docs].max()) < sizes[docs][:, None]
            cells = np.where(inside, starts[docs][:, None] + np.arange(inside.shape[1]), starts[docs][:, None])
            ids = at[cells]
            own = np.empty((len(docs), topics, inside.shape[1]))
            for k in range(topics):
                own[:, k] = by_topic[k][ids]
            yield docs, ids, own, np.where(inside, n[cells], 0.0)

    # documents that need more steps meet again in full batches
    gamma[has], open_, span, taken = 1.0, has, SPAN, 0
    while len(open_):
        most = span if inner is None else min(span, inner - taken)
        span, taken, left = 2 * span, taken + most, []
        for docs, ids, own, counts in together(open_):
            gamma[docs], more = _steps(own, counts, gamma[docs], alpha, most)
            if taken != inner and more.any():
                left.append(docs[more])
                docs, ids, own, counts = (x[~more] for x in (docs, ids, own, counts))
            theta = _theta(gamma[docs])
            per_word = _per_word(theta, own, counts, np.empty((len(docs), 1, ids.shape[1])))
            for k in range(topics):
                sums[k] += np.bincount(ids.ravel(), (theta[:, k, None] * per_word).ravel(), size)
        open_ = np.concatenate([has[:0], *left])
    return gamma, (sums * by_topic).T


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, "zstd"), kind)


def _floats(data: pa.BinaryScalar, topics: int) -> np.ndarray:
    """Topics x terms."""
    return np.frombuffer(data.as_buffer(), float).reshape(topics, -1)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _blocks(counts: DataFrame, key: str) -> tuple[DataFrame, int, int]:
    """(block, keys, ends, entries, at, n, starts, terms, dfs), a row per block, its documents in one list of entries, and how
    many blocks and how many parts there are at most. Terms are numbered part by part: part k begins at ``starts[k]``, and ``terms`` and ``dfs`` have a list for each."""
    cores = counts.sparkSession.sparkContext.defaultParallelism
    entries = counts.count()
    blocks = max(1, -(-entries // BLOCK_ENTRIES), min(4 * cores, entries // LEAST_ENTRIES))
    pieces = min(blocks, max(cores, blocks // 4))
    out = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(counts.schema[key].dataType)),
        T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("entries", T.LongType()),
        T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType()), T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("dfs", T.ArrayType(T.ArrayType(T.LongType())))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if len(x)]
        if not batches:
            return
        rows = pa.Table.from_batches(batches)
        keys = rows["_key"].combine_chunks().dictionary_encode(null_encoding="encode")
        terms = rows["term"].combine_chunks().dictionary_encode()
        documents, at = keys.indices.to_numpy(), terms.indices.to_numpy()
        size = len(terms.dictionary)
        part = np.empty(size, np.int64)
        part[at] = rows["_part"].to_numpy()
        order = np.argsort(part, kind="stable")
        number = np.empty(size, np.int64)
        number[order] = np.arange(size)
        cells = documents.astype(np.int64) * size + number[at]
        sorted_ = np.argsort(cells, kind="stable")
        at = (cells[sorted_] % size).astype(np.int32)
        ends = np.cumsum(np.bincount(documents, minlength=len(keys.dictionary)))
        parts = np.cumsum(np.bincount(part, minlength=pieces))
        dfs = pa.array(np.bincount(at, minlength=size))
        yield from pa.table({
            "block": pa.array([rows["_block"][0].as_py()], pa.int64()), "keys": _one_list(keys.dictionary),
            "ends": pa.array([ends], pa.list_(pa.int64())), "entries": pa.array([len(at)], pa.int64()),
            "at": pa.array([_packed(at)], pa.binary()),
            "n": pa.array([_packed(rows["n"].to_numpy().astype(np.int64)[sorted_])], pa.binary()),
            "starts": pa.array([np.concatenate([[0], parts])], pa.list_(pa.int64())),
            "terms": _one_list(_lists(parts, terms.dictionary.take(pa.array(order)))), "dfs": _one_list(_lists(parts, dfs))}).to_batches()

    # a task gets one block, in any order
    rows = counts.filter(F.col("term").isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"), F.col(key).alias("_key"), "term", "n",
        F.pmod(F.xxhash64("term"), F.lit(pieces)).alias("_part"))
    with setting(counts.sparkSession, BATCH, ANY):
        return materialise(rows.repartitionById(blocks, F.col("_block").cast("int")).mapInArrow(pack, out), "topic-blocks", keep=True), blocks, pieces


def _meet(rows: DataFrame, others: DataFrame, key: str, number: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType | str) -> DataFrame:
    """``run`` for each row by its key, a number below ``number``, and the other rows of that key; a task has one key."""
    columns, more = rows.columns, others.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if len(x)]
        if batches:
            met = pa.Table.from_batches(batches)
            yield from run(met.filter(met["_row"]).select(columns), met.filter(pc.invert(met["_row"])).select(more)).to_batches()

    both = rows.withColumn("_row", F.lit(True)).unionByName(others.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    return both.repartitionById(number, F.col(key).cast("int")).mapInArrow(task, schema)


def _shared(blocks: DataFrame) -> DataFrame:
    """(part, block, terms, dfs): the terms of each part in each block, in the order of their numbers there."""
    return blocks.select("block", F.posexplode(F.arrays_zip("terms", "dfs")).alias("part", "t")).select(
        F.col("part").cast("long").alias("part"), "block", F.col("t.terms").alias("terms"), F.col("t.dfs").alias("dfs")).filter(F.size("terms") > 0)


_WIRE = "part long, terms array<string>, dfs array<long>, blocks array<long>, ends array<long>, at binary"
# A row per part and block with the weights of their terms (``w``), and one per part without a block with its terms.
_STATE = "part long, block long, w binary, terms array<string>, dfs array<long>, weights array<array<double>>"


def _wire(rows: pa.Table) -> pa.Table:
    """A part's terms and, for each of its blocks, which of them stand there."""
    rows = rows.sort_by("block").combine_chunks()
    terms = rows["terms"].combine_chunks().flatten().dictionary_encode()
    at = terms.indices.to_numpy()
    dfs = np.bincount(at, rows["dfs"].combine_chunks().flatten().to_numpy(), len(terms.dictionary)).astype(np.int64)
    ends = np.cumsum(rows["terms"].combine_chunks().value_lengths().to_numpy())
    return pa.table({
        "part": rows["part"][:1], "terms": _one_list(terms.dictionary), "dfs": pa.array([dfs], pa.list_(pa.int64())),
        "blocks": _one_list(rows["block"].combine_chunks()), "ends": pa.array([ends], pa.list_(pa.int64())),
        "at": pa.array([at.astype(np.int32).tobytes()], pa.binary())})


class _Part:
    """A part's row of ``_WIRE``."""

    def __init__(self, row: pa.Table) -> None:
        row = row.combine_chunks()
        self.part, self.terms, self.dfs = (row[x].combine_chunks() for x in ("part", "terms", "dfs"))
        self.blocks, ends = (row[x].combine_chunks().flatten().to_numpy() for x in ("blocks", "ends"))
        self.at = dict(zip(self.blocks.tolist(), np.split(np.frombuffer(row["at"][0].as_buffer(), np.int32), ends[:-1]), strict=True))

    def sums(self, rows: pa.Table, topics: int) -> np.ndarray:
        found = np.zeros((topics, len(self.terms.values)))
        rows = rows.sort_by("block")
        for block, w in zip(rows["block"].to_pylist(), rows["w"], strict=True):
            found[:, self.at[block]] += _floats(w, topics)
        return found

    def state(self, weights: np.ndarray) -> pa.Table:
        """Rows of ``_STATE``; blocks get exp E[log beta] but for the topics' totals."""
        topics, size = weights.shape
        sent = np.exp(digamma(weights))
        w = [np.take(sent, ids, 1).tobytes() for ids in self.at.values()] + [None]
        none = [None] * len(self.at)
        lists = _one_list(_lists(np.arange(1, size + 1) * topics, pa.array(weights.T.ravel())))
        kinds = pa.nulls(len(none), self.terms.type), pa.nulls(len(none), self.dfs.type), pa.nulls(len(none), lists.type)
        own = self.terms, self.dfs, lists
        return pa.table({
            "part": pa.array([self.part[0].as_py()] * len(w), pa.int64()), "block": pa.array([*self.at, None], pa.int64()), "w": pa.array(w, pa.binary()),
            **{x: pa.chunked_array([a, b]) for x, a, b in zip(("terms", "dfs", "weights"), kinds, own, strict=True)}})


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before any round, from rows of ``_WIRE`` with weights."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for i in range(len(table)):
            weights = table["weights"][i].values
            found = weights.flatten().to_numpy().reshape(len(weights), -1).T
            yield from _Part(table.slice(i, 1)).state(np.ascontiguousarray(found)).to_batches()


def _met(block: pa.Table, rows: pa.Table, totals: list[float]) -> np.ndarray:
    """exp E[log beta], topics x terms by their number in the block, of a block of the fit."""
    starts = block["starts"].combine_chunks().flatten().to_numpy()
    beta = np.empty((len(totals), starts[-1]))
    for part, w in zip(rows["part"].to_pylist(), rows["w"], strict=True):
        beta[:, starts[part]:starts[part + 1]] = _floats(w, len(totals))
    return beta * np.exp(-digamma(np.array(totals)))[:, None]


def _found(block: pa.Table, rows: pa.Table, totals: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(exp E[log beta] of other documents' terms, the numbers of those that have weights)."""
    places = rows["place"].to_numpy()
    beta = np.zeros((len(totals), block["starts"].combine_chunks().flatten()[-1].as_py()))
    weights = np.stack([rows[w].to_numpy() for w in _columns("w", len(totals))])
    beta[:, places] = np.exp(digamma(weights) - digamma(np.array(totals))[:, None])
    return beta, places


def _entries(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, at, n)."""
    size = block["entries"][0].as_py()
    return block["ends"].combine_chunks().flatten().to_numpy(), _unpacked(block["at"][0].as_py(), np.int32, size), _unpacked(block["n"][0].as_py(), np.int64, size)


def _columns(letter: str, topics: int) -> list[str]:
    return [f"{letter}{k}" for k in range(topics)]


def _totals(rows: DataFrame, values: list[Column]) -> list[float]:
    return [x or 0.0 for x in rows.agg(*[F.sum(x) for x in values]).first()]


def _expected(totals: list[float], alpha: float, inner: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, own: pa.Table) -> pa.Table:
        sums = block_topics(_met(block, own, totals).T, *_entries(block), alpha, inner)[1].T
        starts, parts = block["starts"].combine_chunks().flatten().to_numpy(), own["part"].to_pylist()
        w = [sums[:, starts[p]:starts[p + 1]].tobytes() for p in parts]
        return pa.table({"part": pa.array(parts, pa.int64()), "block": pa.array([block["block"][0].as_py()] * len(w), pa.int64()), "w": pa.array(w, pa.binary())})

    return run


def _updated(topics: int, eta: float, share: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(wire: pa.Table, sums: pa.Table) -> pa.Table:
        part = _Part(wire)
        if share is None:
            return part.state(eta + part.sums(sums, topics))
        own = pc.is_null(sums["block"])
        before = sums.filter(own)["weights"].combine_chunks().flatten().flatten().to_numpy().reshape(-1, topics).T
        return part.state((1 - share) * before + share * (eta + part.sums(sums.filter(pc.invert(own)), topics)))

    return run


def _terms(state: DataFrame) -> DataFrame:
    """(term, df, weights)."""
    return state.filter(F.col("block").isNull()).select(F.explode(F.arrays_zip("terms", "dfs", "weights")).alias("t")).select(
        F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"), F.col("t.weights").alias("weights"))


def _sent(state: DataFrame) -> DataFrame:
    return state.filter(F.col("block").isNotNull()).select("part", F.col("block").alias("block"), "w")


def _drawn(term: Column, seed: int, k: int) -> Column:
    return 0.5 + F.pmod(F.xxhash64(term, F.lit(seed), F.lit(k)), F.lit(10_007)) / F.lit(10_007.0)


def gamma_drawn(term: Column, seed: int, k: int) -> Column:
    """A gamma variable of shape 100 and mean 1, from a normal one by its cube root (Wilson and Hilferty)."""
    a, b = ((F.pmod(F.xxhash64(term, F.lit(seed), F.lit(k), F.lit(i)), F.lit(2**31 - 1)) + 1) / F.lit(2.0**31) for i in (1, 2))
    normal = F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * b)
    return F.pow(1 - 1 / 900 + normal / 30, F.lit(3.0))


def fit(counts: DataFrame, topics: int = 5, rounds: int = 10, seed: int = 42, key: str = "doc_id", alpha: float | None = None,
        eta: float | None = None, drawn: Callable[[Column, int, int], Column] = _drawn,
        rate: Callable[[int], float] | None = None, inner: int | None = INNER) -> TopicTable:
    """Fit on rows of (key, term, n). Start weights are drawn by hash, the same on every cluster.

    With ``rate`` a round moves the weights by that share of the way, the online form of the updates; rounds count from 1.
    A document takes up to ``inner`` steps, or as many as it needs.
    """
    alpha, eta = (1 / topics if x is None else x for x in (alpha, eta))
    spark = counts.sparkSession
    weights = [F.col("weights")[k] for k in range(topics)]
    with scratch(spark):
        blocks, number, parts = _blocks(counts, key)
        if blocks.isEmpty():
            raise ValueError("no terms to fit topics on")
        wired = materialise(_shared(blocks).groupBy("part").applyInArrow(_wire, _WIRE), "terms")
        drawn = F.transform("terms", lambda t: F.array(*[drawn(t, seed, k) for k in range(topics)]))
        packed = blocks.select("block", "ends", "entries", "at", "n", "starts")
        state = materialise(wired.withColumn("weights", drawn).mapInArrow(_first, _STATE), "topic-sums", keep=not rounds)
        totals = _totals(_terms(state), weights)
        for step in range(1, rounds + 1):
            sums = _meet(packed, _sent(state), "block", number, _expected(totals, alpha, inner), "part long, block long, w binary")
            if rate:
                sums = sums.unionByName(state.filter(F.col("block").isNull()).select("part", "block", "weights"), allowMissingColumns=True)
            met = _meet(wired, sums, "part", parts, _updated(topics, eta, rate and rate(step)), _STATE)
            before, state = state, materialise(met, "topic-sums", keep=step == rounds)
            totals = _totals(_terms(state), weights)
            release(before)
        terms = materialise(_terms(state), "topics", keep=True)
    return TopicTable(terms, totals, alpha, inner, counts, blocks, state, number)


def shares(counts: DataFrame, model: TopicTable, key: str = "doc_id") -> DataFrame:
    """(key, shares, tokens): topic shares of each document that has a known term, and how many known tokens it has."""
    totals, alpha, inner = list(model.totals), model.alpha, model.inner
    kind = counts.schema[key].dataType
    out = T.StructType([T.StructField("_key", kind), T.StructField("shares", T.ArrayType(T.DoubleType())),
                        T.StructField("tokens", T.LongType())])
    same = model.state is not None and counts is model.counts

    def run(block: pa.Table, own: pa.Table) -> pa.Table:
        ends, at, n = _entries(block)
        if same:
            beta = _met(block, own, totals)
        else:
            beta, places = _found(block, own, totals)
            if len(places) < beta.shape[1]:  # entries of terms without weights are left out
                known = np.zeros(beta.shape[1], bool)
                known[places] = True
                kept = known[at]
                ends = np.concatenate([[0], np.cumsum(kept)])[ends]
                at, n = at[kept], n[kept]
        gamma = block_topics(beta.T, ends, at, n, alpha, inner)[0]
        has = np.diff(ends, prepend=0) > 0
        found = gamma[has] / gamma[has].sum(1, keepdims=True)
        tokens = np.diff(np.concatenate([[0], np.cumsum(n)])[ends], prepend=0)[has]
        lists = _lists(np.arange(1, len(found) + 1) * len(totals), pa.array(found.ravel()))
        return pa.table([block["keys"].combine_chunks().flatten().filter(pa.array(has)), lists, pa.array(tokens, pa.int64())], names=out.names)

    if same:
        blocks, number, rows = model.blocks, model.number, _sent(model.state)
    else:
        blocks, number, _ = _blocks(counts, key)
        weights = [F.col("weights")[k].alias(w) for k, w in enumerate(_columns("w", len(totals)))]
        places = blocks.select("block", F.posexplode(F.flatten("terms")).alias("place", "term"))
        rows = lookup_join(places, model.terms, "term", "df").select("block", "place", *weights)
    packed = blocks.select("block", "keys", "ends", "entries", "at", "n", "starts")
    return _meet(packed, rows, "block", number, run, out).withColumnRenamed("_key", key)


def dominant(shared: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, topic, share): the topic of the greatest share, from 1; the first of equal ones."""
    best = F.array_max("shares")
    return shared.select(key, F.array_position("shares", best).cast("int").alias("topic"), best.alias("share"))


def top_words(model: TopicTable, n: int = 10) -> DataFrame:
    """(topic, rank, term, weight): the ``n`` terms of greatest probability per topic, ties by term."""
    parts = []
    for k, total in enumerate(model.totals):  # one small report per topic
        weight = F.col("weights")[k] / F.lit(total)
        best = model.terms.select(F.lit(k + 1).alias("topic"), "term", weight.alias("weight")).orderBy(F.desc("weight"), "term").limit(n)
        listed = best.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("minus"), "term"))).alias("w"))
        parts.append(listed.select("topic", F.posexplode("w").alias("rank", "w")).select(
            "topic", (F.col("rank") + 1).alias("rank"), "w.term", (-F.col("w.minus")).alias("weight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
