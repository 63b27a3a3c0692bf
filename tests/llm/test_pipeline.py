import os
import re

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from pressloom.llm import decontaminate

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == before.columns
        sizes.append(docs.count())
        if name == "quality":
            kept = {r.doc_id for r in docs.collect()}
            assert all((d in kept) == bool(q) for d, q in quality.items())
    assert sizes == sorted(sizes, reverse=True)
    assert decontaminate.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}


def test_registered():
    names = contract.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_line_dedup_counts_short_lines(spark, make):
    texts = [" ".join("abcdefghijkl"[i] * n for n in (3, 4, 5, 6)) + f"\nLes.\nAll rights reserved.\nPage {i}\n{1900 + i}"
             for i in range(12)] + ["Les.", "Rare line\n", "\n\n"]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, make(texts), SF).collect()}
    assert got[0] == texts[0] and 12 not in got  # the first of each stays; all that document 12 says stands there
    assert all(got[i] == "\n".join(texts[i].split("\n")[::4]) for i in range(1, 12))  # bare numbers of their own stay
    assert got[13] == texts[13] and got[14] == texts[14]


def test_line_dedup_keeps_what_stands_nowhere_else(spark, make):
    own = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "theta", "iota"]
    texts = [f"Was erlytion that. {w}" for w in own] + ["Was erlytion that. beta", f"{'x ' * 9}\nWas erlytion that. beta"]
    texts += [f"Page {i} of {i * 7} by printed office" for i in range(9)]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, make(texts), SF).collect()}
    assert {i: texts[i] for i in range(9)} | {10: "x " * 9, 11: texts[11]} == got


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def test_line_dedup_equals_its_sql(spark):
    """Texts of the stage on the whole table beside the SQL of op3, of which documents left without text are taken out."""
    from pressloom.llm.queries import LINES_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {i: t for i, t, _, dropped in con.execute(LINES_SQL).fetchall() if not (dropped and not (t or "").split())}
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert got == want


def test_near_dup_equals_all_pairs(spark):
    """The kept documents beside components of all pairs of five-word shingle sets at 80 %."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        words = plain_words(r.text)
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= 80 * (len(x) + len(y) - shared):
                    low, high = sorted((root(a), root(b)))
                    least[high] = low
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).select("doc_id").collect()}
    assert kept == {d for d in keys if root(d) == d} and len(kept) < len(keys)
