import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pressloom.llm import cuckoo, line_templates, parity_join, passages, words
from pressloom.llm.components import components

VOCAB = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def prose(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def edited(rng, ws, share):
    return [rng.choice(VOCAB) + "x" if rng.random() < share else w for w in ws]


def test_cuckoo_inserts_deletes_and_resizes():
    index, keys = cuckoo.CuckooIndex(lambda a, b: a + b, buckets=1), [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    assert all(index.insert(k, 1) for k in keys) and not index.insert(keys[5], 2)
    assert index.get(keys[5]) == 3 and len(dict(index.items())) == 3000
    assert index.delete(keys[7]) and keys[7] not in index and not index.delete(keys[7]) and all(k in index for k in keys if k != keys[7])


def test_exact_dedup(make):
    texts = [(3, "a  b"), (1, "a\tb"), (1, "a\tb"), (2, "a b "), (4, None), (5, ""), (None, "a b"), (6, "x" * 100_000)]
    rows = cuckoo.dedup(make(texts), shard_keys=2).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in rows) == [
        (-1, 1, 4, False), (1, 1, 4, False), (1, 1, 4, True), (2, 2, 1, True), (3, 1, 4, False), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 1, True)]
    assert {r.text_sha256 for r in rows if r.doc_id == 3} == {hashlib.sha256(b"a b").hexdigest()}
    assert cuckoo.dedup(make([])).count() == 0


def test_index_updates(spark):
    change = lambda *rows: spark.createDataFrame([(bytes([d]), n) for d, n in rows], "digest binary, delta int")
    index = cuckoo.update_index(None, change((1, 1), (1, 1), (2, 1), (3, -1)), 2)
    after = cuckoo.update_index(index, change((1, -1), (2, -1), (4, 1)), 2)
    assert sorted((r.digest, r.live) for r in after.collect()) == [(b"\x01", 1), (b"\x04", 1)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    for limit in (500_000, 3):
        assert {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), limit).collect()} == want


def shingles(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


@pytest.mark.parametrize("k,percent,glance", [(3, 90, 64), (5, 80, 64), (5, 80, 1)])
def test_parity_join_equals_brute_force(make, monkeypatch, k, percent, glance):
    monkeypatch.setattr(parity_join, "GLANCE", glance)  # 1: every shared bucket counts as hot
    rng = random.Random(k)
    bases = [prose(rng, n) for n in (5, 12, 40, 120, 121, 400)]
    shared = prose(rng, 30)
    texts = [" ".join(edited(rng, b, s)) for b in bases for s in (0, 0, 0.005, 0.01, 0.02, 0.03)]
    texts += [" ".join(prose(rng, 60) + shared + prose(rng, 20)) for _ in range(15)] + [None, "", "   ", "One", "one", "one two", "ONE  two"]
    docs = make([*enumerate(texts), (None, texts[0]), (0, texts[0])])
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = parity_join.link(docs, k=k, percent=percent).collect()
    assert len(got) == len(texts) + 2
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {
        (i, len(s), find(i)) for i, s in enumerate(sets)}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert parity_join.link(make([]), k=k, percent=percent).count() == 0
    assert {r.doc_id for r in parity_join.keep_one(docs, k=k, percent=percent).collect()} == {None} | {i for i in range(len(texts)) if find(i) == i}


def test_line_templates(make):
    body = ["unique line number %s with own words here" % w for w in VOCAB[:30]]
    texts = [f"{body[i]}\nPage {i} of {i * 7} by printed office\nshort one" for i in range(20)] + [None, "", "only this line stands here alone"]
    rows = {r.doc_id: r for r in line_templates.clean(make(texts)).collect()}
    assert rows[0].text == texts[0] and rows[0].n_dropped == 0  # the first occurrence stays
    assert all(rows[i].text == body[i] and rows[i].n_dropped == 2 for i in range(1, 20))  # short lines recur too
    longer = {r.doc_id: r.text for r in line_templates.clean(make(texts), min_tokens=4).collect()}
    assert all(longer[i] == f"{body[i]}\nshort one" for i in range(1, 20))
    assert rows[20].text is None and rows[21].text == "" and rows[22].text == texts[22] and rows[20].key == "x"
    copies = line_templates.clean(make(["the same four words here"] * 9), drop_emptied=True).collect()
    assert [r.doc_id for r in copies] == [0]
    assert line_templates.clean(make([])).count() == 0


def test_lines_with_words_of_their_own_stay(make):
    texts = [f"Was it that {w}" for w in VOCAB[:9]] + [f"Was it that {i}" for i in range(9)]
    kept = [r.text for r in line_templates.clean(make(texts)).collect() if r.text]
    assert sorted(kept) == sorted(texts[:9] + texts[9:10])  # digits are no words
    loose = line_templates.clean(make(texts), each_text=False).collect()
    assert [r.text for r in loose if r.text] == texts[:1]


def test_line_templates_beside_clashing_columns_null_and_repeated_keys(make):
    texts = [(None if i < 3 else 5, f"own {w} words of this line\nAll the same here 7") for i, w in enumerate(VOCAB[:12])] + [(5, "x " * 50_000 + "\nAll the same here 7")]
    docs = make(texts).withColumnsRenamed({"key": "_drop", "size": "n_dropped", "lang": "_key", "source": "_text"})
    rows = line_templates.clean(docs).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "_key", "_text", "n_chars", "_drop", "n_lines", "n_dropped"}
    assert sum(r.n_dropped for r in rows) == 12 and sum("All the same" in r.text for r in rows) == 1 and len(rows) == 13
    assert {r._drop for r in rows} == {"x"} and max(len(r.text) for r in rows) == 100_000


def test_passages_cover_every_repeated_run(make):
    rng = random.Random(5)
    run = prose(rng, 70)
    fuzzy = edited(rng, run, 0.06)
    texts = [" ".join(prose(rng, 40) + run + prose(rng, 40)), " ".join(prose(rng, 90)), " ".join(prose(rng, 10) + run + prose(rng, 80)),
             " ".join(prose(rng, 30) + fuzzy + prose(rng, 30)), " ".join(run).upper(), None, "", "few words", " ".join(prose(rng, 200)) + " " + " ".join(run[:20])]
    found = passages.find(make([*enumerate(texts), (None, texts[0])])).collect()
    spans = defaultdict(list)
    for r in found:
        spans[r.doc_id].append((r.start_word, r.end_word, r.source_id))
    assert set(spans) == {2, 3, 4}
    (s, e, source), = spans[2]
    assert source == 0 and abs(s - 10) <= 3 and abs(e - 80) <= 3
    assert spans[3][0][0] <= 36 and spans[3][0][1] >= 94 and spans[4] == [(0, 70, 0)]
    assert passages.find(make([])).count() == 0


def test_chain_is_the_best_of_all_chains():
    rng = random.Random(2)
    for _ in range(50):
        parts = sorted({(rng.randint(0, 60), rng.randint(0, 60), 5) for _ in range(9)})
        best = passages.chains(parts, 0.1, 1000)[0]
        assert all(b[0] >= a[0] + 5 and b[1] >= a[1] + 5 for a, b in zip(best, best[1:]))
        gain = lambda c: 5 * len(c) - 0.1 * sum(b[0] - a[0] - 5 + b[1] - a[1] - 5 for a, b in zip(c, c[1:]))
        every = [[p] for p in parts]
        for c in every:
            every += [[*c, p] for p in parts if p[0] >= c[-1][0] + 5 and p[1] >= c[-1][1] + 5]
        assert gain(best) == pytest.approx(max(map(gain, every)))


def test_chain_steps_are_bounded_inside_the_maximum():
    parts = [(0, 0, 1000), (1300, 1300, 20), (1330, 1340, 20), (1360, 1380, 20), (1390, 1420, 20)]
    assert passages.chains(parts, max_gap=40) == [parts[:1], parts[1:]]  # the long passage is too far away to step from
    rng = random.Random(3)
    near = lambda a, b: all(0 <= b[x] - a[x] - a[2] <= 40 for x in (0, 1))
    step = lambda a, b: 0.1 * sum(b[x] - a[x] - a[2] for x in (0, 1))
    for _ in range(100):
        parts = [(0, 0, 200), *sorted({(rng.randint(200, 420), rng.randint(200, 420), rng.randint(5, 30)) for _ in range(25)})]
        best = []
        for i, p in enumerate(parts):
            best.append(p[2] + max([0.0] + [best[j] - step(q, p) for j, q in enumerate(parts[:i]) if near(q, p)]))
        got = passages.chains(parts, 0.1, 40)
        assert all(near(a, b) for c in got for a, b in zip(c, c[1:]))
        gain = lambda c: sum(p[2] for p in c) - sum(step(a, b) for a, b in zip(c, c[1:]))
        assert max(map(gain, got)) == pytest.approx(max(best))


def test_passages_whose_parts_occur_first_elsewhere(make):
    rng = random.Random(6)
    run = prose(rng, 60)
    around = lambda ws: " ".join(prose(rng, 40) + ws + prose(rng, 40))
    for firsts in ([around(run[:30]), around(run[30:])], [around(run[30:] + prose(rng, 300) + run[:30])]):
        n = len(firsts)
        found = passages.find(make([*firsts, around(run), around(run), around(run).upper()])).collect()
        spans = {(r.doc_id, r.source_id): (r.start_word, r.end_word) for r in found if r.source_id == n}
        assert set(spans) == {(n + 1, n), (n + 2, n)}
        assert all(s <= 42 and e >= 98 for s, e in spans.values())


def test_edited_passages_share_enough_seeds(make):
    rng = random.Random(9)
    runs = [prose(rng, 100) for _ in range(80)]
    texts = [" ".join(prose(rng, 40) + r + prose(rng, 40)) for r in runs]
    texts += [" ".join(prose(rng, 20) + edited(rng, r, 0.15) + prose(rng, 50)) for r in runs]
    found = {(r.doc_id, r.source_id) for r in passages.find(make(texts)).collect()}
    assert sum((80 + i, i) in found for i in range(80)) >= 76  # each is a repeat of 85 % identity
