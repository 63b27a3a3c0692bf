from pyspark.sql import functions as F

from pressloom.functions import text
from pressloom.operators import classify, clean, tfidf
from pressloom.plans import steps


def test_section_labels(spark):
    names = ["MONEY", "Finance/Business", "Business; Part B; Business Desk", "Arts & Entertainment", "Metro", None, "Life!"]
    rows = spark.createDataFrame([(n,) for n in names], "s string")
    label = lambda strict: [r[0] for r in rows.select(clean.section_label(F.col("s"), strict)).collect()]
    assert label(False) == [1, 1, 1, 0, None, None, 0]
    assert label(True) == [1, None, None, None, None, None, 0]


def training(spark):
    money, arts = "bank rates inflation budget market loan", "film actor stage music gallery novel"
    rows = [(str(i), " ".join((money if i % 2 else arts).split()[j % 6] for j in range(i % 5, i % 5 + 12)), "Money" if i % 2 else "Arts")
            for i in range(80)]
    return spark.createDataFrame(rows + [("s", "short", "Money"), ("n", None, "Arts"), ("m", "x" * 50, "Metro")], "goid string, text string, section string")


def test_short_and_unlabelled_rows_are_dropped(spark):
    assert clean.labelled_sections(training(spark)).count() == 80


def test_training_separates_the_classes(spark, tmp_path):
    model, test = classify.train(training(spark))
    assert 0 < test.count() < 40
    scored = {r.goid: r.is_economic for r in classify.score(training(spark), model).collect()}
    assert scored["n"] is None
    assert all((scored[str(i)] > 0.5) == (i % 2 == 1) and scored[str(i)] == round(scored[str(i)], 4) for i in range(80))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = classify.PipelineModel.load(str(tmp_path / "m"))
    assert {r.goid: r.is_economic for r in classify.score(training(spark), again).collect()} == scored


def test_coefficient_table_gives_the_model_probability(spark):
    model, _ = classify.train(training(spark), fit_on_all=True)
    vectoriser, weigh, _, regression = model.stages
    rows = classify.prepared(training(spark).filter("text is not null"), "text").select("goid", F.array_join("terms", " ").alias("text"))
    labelled = clean.labelled_sections(training(spark)).select("goid", F.col("processed_text").alias("text"))
    terms = tfidf.fit(labelled, max_features=classify.FEATURES, key="goid")
    table = spark.createDataFrame(list(zip(vectoriser.vocabulary, map(float, regression.coefficients))), "term string, coefficient double")
    flat = {r.goid: r.is_economic for r in classify.score_with_coefficients(rows, terms, table, regression.intercept).collect()}
    piped = {r.goid: r.is_economic for r in classify.score(training(spark), model).collect()}
    assert all(abs(flat[g] - piped[g]) <= 1e-4 for g in flat) and len(flat) == 82


def test_split_depends_on_the_key_alone(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("goid"))
    a, b = classify.split_by_key(rows, "goid")
    c, _ = classify.split_by_key(rows.repartition(9), "goid")
    assert a.count() + b.count() == 2000 and 1500 < a.count() < 1700
    assert sorted(a.collect()) == sorted(c.collect())


def test_report(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.5), (1, 0.2), (0, 0.7), (0, 0.1)], "label int, probability double")
    got = {r["class"]: r for r in classify.classification_report(rows).collect()}
    one, zero = got["1"], got["0"]
    assert (round(one.precision, 4), round(one.recall, 4), round(one.f1, 4), one.support) == (0.6667, 0.6667, 0.6667, 3)
    assert (zero.precision, zero.recall, zero.support) == (0.5, 0.5, 2)
    assert got["accuracy"].f1 == 0.6 and got["accuracy"].support == 5
    assert round(got["macro avg"].f1, 4) == 0.5833 and round(got["weighted avg"].f1, 4) == 0.6


def test_report_without_predictions_of_a_class(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9)], "label int, probability double")
    zero = {r["class"]: r for r in classify.classification_report(rows).collect()}["0"]
    assert (zero.precision, zero.recall, zero.f1, zero.support) == (0.0, 0.0, 0.0, 1)


def test_texts_are_cleaned_once_and_a_choice_runs_the_model_once(spark):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert plan(clean.labelled_sections(training(spark))).count("lower(text") == 1
    model, _ = classify.train(training(spark))
    rows = training(spark).select("goid", "text")
    scored, names = steps.select_economic(rows, model)
    assert plan(names).count("UDF(") == plan(scored).count("UDF(") > 0


def test_tokens_of_a_text_are_those_of_its_cleaned_form(spark):
    texts = ["ΑΣ ΣΑΣ", "İstanbul I.İ", "ǅabc ß_x", "a-b c'd e1", "x́y ÄÖ", "  ", "", None, "日本 語", "Ω​AB CD", "a\u0085bc de"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("cleaned", text.clean_text(F.col("text")))
    got = classify.prepared(rows, "text").drop("text").select("i", F.col("terms").alias("a"), "cleaned")
    assert all(r.a == r.terms for r in classify.prepared(got, "cleaned").collect())
