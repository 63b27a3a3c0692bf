import random
import re

import pytest

from pressloom.llm import licenses
from pressloom.llm.license_rules import BASE, Rule, rules

PIECES = ["Licensed under CC BY-NC 4.0.", "All rights reserved.", "cc by", "GNU General Public License", "version 3", "MIT License", "the", "naïve",
          "Apache License, Version 2.0", "SPDX-License-Identifier: MIT", "© 2020", "http://www.apache.org/licenses/LICENSE-2.0", "general public", "x"]


def plain_scan(text):
    """Every rule on every text, every pair of detections compared."""
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    joined = " " + " ".join(words) + " "
    found = []
    for i, rule in enumerate(rules()):
        for m in re.finditer("(?<= )(?:" + rule.pattern + ")(?= )", joined, re.S):
            found.append((joined.count(" ", 0, m.start()) - 1, joined.count(" ", 0, m.end()) - 1, rule.priority, i))
    def beats(e, d):
        covers = e[0] <= d[0] and e[1] >= d[1]
        longer = (e[0], e[1]) != (d[0], d[1])
        return covers and (e[2] < d[2] or e[2] == d[2] and (longer or e[3] < d[3]))
    kept = {d for d in found if not any(beats(e, d) for e in found)}
    table = rules()
    base = [d for d in found if table[d[3]].base]
    places = [i for phrase, _ in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    assert sorted(d[0] for d in base) == sorted(places)
    labels = {table[d[3]].label for d in kept} | {table[d[3]].label for d in base}
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({table[d[3]].label for d in base})),
            ",".join(sorted(labels)), max((licenses.CONFIDENCE[d[2]] for d in kept | set(base)), default=0.0))


def test_scan_equals_plain_scan(spark, make):
    rng = random.Random(3)
    texts = [rng.choice([" ", "\n", " // ", "; "]).join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(300)]
    texts += [None, "", " .,; ", "All rights\n * reserved", "CC BY" * 3, "cc by x", texts[0], texts[0], "word " * 50_000 + "cc by " * 3_000]
    docs = make([*enumerate(texts), (None, "cc by")])
    rows = licenses.digest(licenses.scan(docs)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = "cc by" if r.doc_id is None else texts[r.doc_id] or ""
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        if len(text) < 10_000:
            assert got == plain_scan(text), text
        else:
            assert got == (56_000, 3_000, 50_000, 55_998, "cc-by", "cc-by", 0.7)
    assert licenses.digest(licenses.scan(make([]))).count() == 0


def test_scan_equals_plain_scan_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = licenses.digest(licenses.scan(docs)).collect()
    assert len(rows) == len(texts)
    assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == plain_scan(texts[r.doc_id]) for r in rows)


def test_rules_are_found_with_and_without_the_gate():
    table = rules()
    scanner = licenses.Scanner(table)
    assert len(table) > 400 and len({(r.label, r.pattern) for r in table}) == len(table)
    rng = random.Random(5)
    for _ in range(200):
        text = licenses.plain(" ".join(rng.choices([r.keyword for r in table] + PIECES, k=6)).encode())
        assert scanner.spans(text) == scanner.spans(text, range(len(table)))


@pytest.mark.parametrize("seed", range(20))
def test_suppression_equals_all_pairs(seed):
    rng = random.Random(seed)
    found = [(a, a + rng.randint(0, 6), rng.randint(1, 4), i) for i, a in enumerate(rng.choices(range(12), k=40))]
    def beats(e, d):
        covers = e[0] <= d[0] and e[1] >= d[1]
        return covers and (e[2] < d[2] or e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3]))
    assert licenses.kept(found) == [not any(beats(e, d) for e in found) for d in found]


def test_own_rules(spark, make):
    table = [Rule("a", 1, "one", "one two"), Rule("b", 2, "two", "two"), Rule("c", 1, "two", "two three")]
    row = licenses.scan(make(["One, two three two"]), table).first()
    assert [(s.label, s.kept, s.first_word, s.last_word) for s in row.spans] == [("a", True, 0, 1), ("b", False, 1, 1), ("b", True, 3, 3), ("c", True, 1, 2)]
