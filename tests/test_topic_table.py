import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressloom.operators import scale, topic_table

THEMES = (["bank", "money", "loan", "rate"], ["goal", "team", "match", "coach"], ["rain", "cloud", "storm", "wind"])


def themed(spark, n=60):
    rng = random.Random(2)
    rows = []
    for d in range(n):
        words = rng.choices(THEMES[d % 3], k=30) + rng.choices(sum(THEMES, []), k=3)
        rows += [(d, w, words.count(w)) for w in sorted(set(words))]
    return spark.createDataFrame(rows, "doc_id long, term string, n long")


def plain_fit(rows, terms, start, rounds, topics):
    """The same updates with whole matrices in one place."""
    alpha = eta = 1 / topics
    lam = start.copy()
    docs = sorted({d for d, _, _ in rows})
    for _ in range(rounds):
        beta = np.exp(topic_table.digamma(lam) - topic_table.digamma(lam.sum(0)))
        stats = np.zeros_like(lam)
        for d in docs:
            own = [(terms.index(t), n) for x, t, n in rows if x == d]
            ids, n = np.array([i for i, _ in own]), np.array([n for _, n in own], float)
            np.add.at(stats, ids, topic_table.document_topics(beta[ids], n, alpha)[1])
        lam = eta + stats
    return lam


def test_digamma():
    euler = 0.57721566490153286
    harmonic = [sum(1 / i for i in range(1, n)) - euler for n in range(1, 30)]
    assert np.allclose(topic_table.digamma(np.arange(1.0, 30)), harmonic, atol=1e-10)
    assert math.isclose(float(topic_table.digamma(np.array(0.5))), -euler - 2 * math.log(2), rel_tol=1e-9)


@pytest.mark.parametrize("limit", [None, 2])
def test_fit_equals_the_updates_in_one_place(spark, monkeypatch, limit):
    """Also when the term table is far too long to broadcast."""
    if limit:
        monkeypatch.setattr(scale, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(scale, "HOT_ROWS", limit)
    counts = themed(spark, 20)
    rows = [tuple(r) for r in counts.collect()]
    start = topic_table.fit(counts, 3, rounds=0)
    first = {r.term: r.weights for r in start.terms.collect()}
    terms = sorted(first)
    want = plain_fit(rows, terms, np.array([first[t] for t in terms]), 3, 3)
    model = topic_table.fit(counts.repartition(5), 3, rounds=3)
    got = {r.term: r.weights for r in model.terms.collect()}
    assert np.allclose([got[t] for t in terms], want, rtol=1e-8) and np.allclose(model.totals, want.sum(0))


def test_themes_are_told_apart(spark):
    counts = themed(spark)
    model = topic_table.fit(counts, 3, rounds=15)
    shared = topic_table.shares(counts, model)
    topics = {r.doc_id: r.topic for r in topic_table.dominant(shared).collect()}
    assert len({topics[d] for d in range(3)}) == 3 and all(topics[d] == topics[d % 3] for d in range(60))
    for r in shared.collect():
        assert abs(sum(r.shares) - 1) < 1e-9 and r.tokens == 33
    words = topic_table.top_words(model, 4).collect()
    by_topic = {k: [r.term for r in sorted(words, key=lambda r: r["rank"]) if r.topic == k] for k in (1, 2, 3)}
    assert sorted(map(sorted, by_topic.values())) == sorted(map(sorted, THEMES))


def test_empty_and_unknown_terms(spark):
    counts = themed(spark, 6)
    with pytest.raises(ValueError, match="no terms"):
        topic_table.fit(counts.limit(0), 3)
    model = topic_table.fit(counts, 2, rounds=1)
    other = spark.createDataFrame([(1, "nowhere", 3), (2, "bank", 2), (None, "bank", 1)], "doc_id long, term string, n long")
    assert sorted((r.doc_id, r.tokens) for r in topic_table.shares(other, model).collect() if r.doc_id) == [(2, 2)]
    assert topic_table.shares(other.limit(0), model).count() == 0
    assert topic_table.dominant(topic_table.shares(other.filter("doc_id = 2"), model)).select(F.col("topic").between(1, 2).alias("x")).first().x


def test_documents_of_a_block_are_solved_as_each_alone():
    """Together, with terms of other documents and none between them, as by the plain loop over one document."""
    rng = np.random.default_rng(4)
    beta = rng.random((50, 3))
    docs = [(np.sort(rng.choice(50, size, replace=False)), rng.integers(1, 5, size)) for size in (7, 0, 50, 1, 7, 30)]
    ends = np.cumsum([len(ids) for ids, _ in docs])
    at, n = (np.concatenate([d[i] for d in docs]) for i in (0, 1))
    gamma, sums = topic_table.block_topics(beta, ends, at, n, 0.3)
    want = np.zeros_like(beta)
    for d, (ids, counts) in enumerate(docs):
        if not len(ids):
            assert (gamma[d] == 0).all()
            continue
        own = np.ones(3)
        for _ in range(topic_table.INNER):
            theta = np.exp(topic_table.digamma(own) - topic_table.digamma(own.sum()))
            before, own = own, 0.3 + theta * (beta[ids].T @ (counts / (beta[ids] @ theta)))
            if np.abs(own - before).mean() < topic_table.CLOSE:
                break
        theta = np.exp(topic_table.digamma(own) - topic_table.digamma(own.sum()))
        want[ids] += beta[ids] * theta * (counts / (beta[ids] @ theta))[:, None]
        assert np.allclose(gamma[d], own)
    assert np.allclose(sums, want)


def test_a_round_moves_a_row_per_block_and_term(spark, monkeypatch):
    """Not one per document and term: 60 documents of few words meet their weights in as many rows as there are words."""
    written = []
    keep = topic_table.materialise
    monkeypatch.setattr(topic_table, "materialise", lambda df, name, **more: (written.append((name, keep(df, name, **more))), written[-1][1])[1])
    sizes = []
    totals = topic_table._totals
    monkeypatch.setattr(topic_table, "_totals", lambda rows, values: (sizes.append(rows.count()), totals(rows, values))[1])
    counts = themed(spark)
    topic_table.fit(counts, 3, rounds=2)
    assert sizes == [12, 12, 12] and counts.count() > 200 and {n for n, _ in written} == {"topic-blocks", "terms", "topic-sums", "topics"}


def by_term(model):
    return {r.term: (r.df, r.weights) for r in model.terms.collect()}


def test_a_round_moves_a_row_per_block_and_part(spark, monkeypatch):
    """Not one per block and term; many blocks fit as one does."""
    counts = themed(spark)
    one = topic_table.fit(counts, 3, rounds=3)
    monkeypatch.setattr(topic_table, "BLOCK_ENTRIES", counts.count() // 3)
    rows, keep = [], topic_table.materialise

    def watched(df, name, **more):
        out = keep(df, name, **more)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(topic_table, "materialise", watched)
    many = topic_table.fit(counts, 3, rounds=3)
    blocks = dict(rows)["topic-blocks"]
    assert blocks > 1 and all(n <= blocks * (blocks + 1) for name, n in rows if name == "topic-sums") and len([n for n, _ in rows if n == "topic-sums"]) == 4
    a, b = by_term(one), by_term(many)
    assert a.keys() == b.keys() and all(a[t][0] == b[t][0] and np.allclose(a[t][1], b[t][1]) for t in a)


@pytest.mark.parametrize("entries", [10_000, 40])
def test_shares_of_the_fitted_rows_use_its_blocks(spark, monkeypatch, entries):
    """They are not placed again, and come out as for the same rows from elsewhere."""
    monkeypatch.setattr(topic_table, "BLOCK_ENTRIES", entries)
    counts = themed(spark, 12)
    model = topic_table.fit(counts, 3, rounds=2)
    other = {r.doc_id: r for r in topic_table.shares(counts.select("*"), model).collect()}
    monkeypatch.setattr(topic_table, "_blocks", None)
    own = {r.doc_id: r for r in topic_table.shares(counts, model).collect()}
    assert own.keys() == other.keys() == set(range(12))
    assert all(own[d].tokens == other[d].tokens and np.allclose(own[d].shares, other[d].shares) for d in own)


def test_a_task_has_one_key(spark):
    """By its number and not by a hash of it; the columns of the two sides stay apart."""
    rows = spark.createDataFrame([(k, k * 10) for k in range(7)], "block long, x long")
    others = spark.createDataFrame([(k, f"{k}{i}") for k in range(6) for i in range(3)], "block long, w string").repartition(4)

    def run(row, more):
        return pa.table({"x": row["x"], "n": pa.array([len(more)] * len(row)), "w": pa.array(["".join(sorted(more["w"].to_pylist()))] * len(row))})

    met = topic_table._meet(rows, others, "block", 7, run, "x long, n long, w string")
    assert sorted(tuple(r) for r in met.collect()) == [(k * 10, 3 if k < 6 else 0, "".join(f"{k}{i}" for i in range(3)) if k < 6 else "") for k in range(7)]
    assert [r[0] for r in met.groupBy(F.spark_partition_id()).count().select("count").collect()] == [1] * 7
