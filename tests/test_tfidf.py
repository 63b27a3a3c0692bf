import math

from pyspark.sql import functions as F

from pressloom.operators import tfidf
from pressloom.plans import steps

DOCS = [(1, "Rates rise as rates rise again"), (2, "banks cut rates"), (3, "the the the"), (4, "banks banks rise _x 9 99")]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string")


def test_idf(spark):
    model = tfidf.fit(docs(spark))
    got = {r.term: (r.df, round(r.idf, 9)) for r in model.terms.collect()}
    assert got["rates"] == (2, round(math.log(5 / 3) + 1, 9)) and "the" not in got and "9" not in got and got["99"][0] == 1
    plain = tfidf.fit(docs(spark), idf=tfidf.plain_idf)
    assert round({r.term: r.idf for r in plain.terms.collect()}["rates"], 9) == round(math.log(4 / 2), 9)


def test_vectors_have_unit_length(spark):
    model = tfidf.fit(docs(spark))
    lengths = tfidf.scores(tfidf.transform(docs(spark), model)).groupBy("doc_id").agg(F.sum(F.col("score") * F.col("score")).alias("s"))
    assert {r.doc_id for r in lengths.collect()} == {1, 2, 4} and all(abs(r.s - 1) < 1e-12 for r in lengths.collect())


def test_hot_terms_split_gives_the_same_scores(spark):
    model = tfidf.fit(docs(spark))
    whole, split = (
        sorted((r.doc_id, r.term, round(r.score, 12)) for r in tfidf.scores(tfidf.transform(docs(spark), model, broadcast_limit=n)).collect())
        for n in (1000, 3))
    assert whole == split


def test_keywords(spark):
    words = {r.doc_id: r.tf_idf for r in tfidf.keywords(tfidf.transform(docs(spark), tfidf.fit(docs(spark))), 2).collect()}
    assert [k.term for k in words[4]] == ["banks", "99"] and words[4][0].score >= words[4][1].score
    # equal weights: by term
    assert [k.term for k in words[1]] == ["rates", "rise"]


def test_bounded_vocabulary(spark):
    assert sorted(r.term for r in tfidf.fit(docs(spark), max_features=3).terms.collect()) == ["banks", "rates", "rise"]


def test_save_and_load(spark, tmp_path):
    model = tfidf.fit(docs(spark))
    model.save(str(tmp_path / "m"))
    again = tfidf.TfidfModel.load(spark, str(tmp_path / "m"))
    assert again.documents == 4 and sorted(again.terms.collect()) == sorted(model.terms.collect())


def test_tagging_keeps_existing_keywords(spark):
    model = tfidf.fit(docs(spark))
    rows = docs(spark).withColumn("name", F.col("doc_id"))
    manifest = spark.createDataFrame([(1,), (2,)], "name bigint")
    once = steps.tag_keywords(rows, model, manifest, 1, "doc_id")
    assert {r.doc_id: r.tf_idf and r.tf_idf[0].term for r in once.collect()} == {1: "rates", 2: "cut", 3: None, 4: None}
    twice = steps.tag_keywords(once, model, None, 2, "doc_id")
    got = {r.doc_id: r.tf_idf and [k.term for k in r.tf_idf] for r in twice.collect()}
    assert got == {1: ["rates"], 2: ["cut"], 3: None, 4: ["banks", "99"]}


def test_one_shuffle_of_the_texts(spark):
    model = tfidf.fit(docs(spark))
    plan = tfidf.keywords(tfidf.transform(docs(spark), model))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_only_rare_terms_are_shuffled(spark, monkeypatch):
    """Beyond the broadcast bounds: the frequent terms' rows stay with their documents."""
    from pressloom.operators import scale

    rows = spark.createDataFrame([(d, f"rates banks rise w{d} w{d // 2}x") for d in range(40)], "doc_id bigint, text string")
    model = tfidf.fit(rows)
    assert scale.frequent_rows(model.terms, "df") is None
    kept = model.terms.filter(scale.frequent_rows(model.terms, "df", 30)).collect()
    assert {r.term for r in kept} == {"rates", "banks", "rise", *(f"w{d}x" for d in range(20))}
    assert model.terms.filter(scale.frequent_rows(model.terms, "df", 2)).isEmpty()
    whole, split, none = (sorted((r.doc_id, round(r.norm, 12), sorted((w.term, round(w.raw, 12)) for w in r.weights))
                                 for r in tfidf.transform(rows, model, broadcast_limit=n).collect()) for n in (None, 30, 2))
    assert whole == split == none and len(whole) == 40


def test_rows_are_counted_in_place(spark):
    plan = tfidf.term_rows(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
    assert {(r.term, r.tf) for r in tfidf.term_rows(docs(spark)).collect() if r.doc_id == 1} == {("rates", 2), ("rise", 2)}
