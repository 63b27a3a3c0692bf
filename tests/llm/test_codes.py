import hashlib

import numpy as np
import pytest

from pressloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"  # the last two clash with results


def brute(rows, parts=4, entries=256, rounds=4):
    """Rows of (id, label, components) by the rule, every entry compared."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    whole = [[int(np.floor(1024 * np.float64(x))) for x in r[2]] for r in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    def nearest(v, book):
        squares = [sum((a - b) ** 2 for a, b in zip(v, e)) for e in book]
        return min(range(len(book)), key=lambda i: (squares[i], i)), min(squares)
    for _ in range(rounds):
        for p in range(parts):
            chosen = [nearest(c[p], books[p])[0] for c in cut]
            for e in set(chosen):
                mine = [c[p] for c, x in zip(cut, chosen) if x == e]
                books[p][e] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    sums = {}
    for r, f in zip(rows, found):
        sums[r[1]] = sums.get(r[1], 0) + sum(d for _, d in f)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, "".join(f"{i:02x}" for i, _ in f), sum(d for _, d in f), sums[r[1]], sha) for r, f in zip(rows, found))


def run(docs):
    coded, books = codes.compress(docs)
    done = codes.with_label_error(coded)
    assert done.columns[:4] == ["vec_id", "label", "code", "error"]
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, books.sha256) for r in done.collect())


@pytest.mark.parametrize("n, spread", [(400, 1.0), (60, 0.002), (300, 2000.0)])
def test_codes_equal_brute_force(spark, n, spread):
    rng = np.random.default_rng(n)
    rows = [(i * 3, None if i % 7 == 0 else i % 4, [float(x) for x in (rng.normal(size=12) * spread).astype(np.float32)]) for i in range(n)]
    rows += [(None, 1, rows[0][2]), (3, 2, rows[5][2])]
    nan, inf = float("nan"), float("inf")
    bad = [(1000, None, 1), (1001, [1.0] * 11 + [None], 1), (1002, [nan] * 12, 1), (1003, [inf] + [0.0] * 11, None)]
    docs = spark.createDataFrame([(i, v, label, "x", 1) for i, label, v in rows] + [(i, v, label, "x", 1) for i, v, label in bad], SCHEMA)
    assert run(docs.repartition(5)) == brute(rows)


def test_rows_that_cannot_be_coded(spark):
    rows = [(i, [float(i)] * 8, 0, "x", 1) for i in range(5)]
    docs = spark.createDataFrame(rows + [(7, [1.0] * 4, 0, "x", 1), (8, [], 0, "x", 1), (9, [1e30] * 8, 5, "x", 1)], SCHEMA)
    got = {r[1]: r for r in run(docs)}
    assert [got[i][2] for i in range(5)] == [f"{i:02x}" * 4 for i in range(5)] and all(got[i][2:4] == (None, None) for i in (7, 8, 9))
    assert got[7][4] == 0 and got[9][4] is None
    assert run(docs.limit(0)) == [] and run(docs.filter("vec_id = 8"))[0][2] is None


@pytest.mark.parametrize("stride", [1, 3, 8])
def test_search_equals_brute_force_with_ties(monkeypatch, stride):
    monkeypatch.setattr(codes, "STRIDE", stride)
    rng = np.random.default_rng(stride)
    for i in range(100):
        entries = rng.integers(-2, 3, (int(rng.integers(1, 60)), 3)).astype(float)
        queries = rng.integers(-3, 4, (40, 3)).astype(float)
        squares = ((queries[:, None] - entries[None]) ** 2).sum(2)
        if i % 3 == 0:
            entries, queries = codes._integers(entries), codes._integers(queries)
        found, best, compared = codes.orchard(queries, codes.lists(entries))
        assert (found == squares.argmin(1)).all() and (best == squares.min(1)).all() and compared <= squares.size


def test_near_groups_are_searched_in_part():
    rng = np.random.default_rng(9)
    centres = rng.integers(-10_000, 10_000, (16, 8))
    entries = (np.repeat(centres, 16, 0) + rng.integers(-50, 50, (256, 8))).astype(float)
    queries = entries[rng.integers(0, 256, 1000)] + rng.integers(-20, 20, (1000, 8))
    _, _, compared = codes.orchard(queries, codes.lists(entries))
    assert compared < 0.5 * 256 * 1000
