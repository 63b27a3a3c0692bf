from pyspark.sql import functions as F

from pressloom.catalog.base import term_mark
from pressloom.operators import sentiment
from pressloom.plans import steps
from pressloom.schema import BERT_PARAGRAPH, BERT_TITLE, ROBERTA_PARAGRAPH, ROBERTA_TITLE

ROWS = [("1", "Good title", ["para one", "para two"]), ("2", None, None), ("3", "", ["  "]), ("4", "x y", None)]


def articles(spark):
    return spark.createDataFrame(ROWS, "goid string, title string, paragraph_text array<string>")


def fixed_model():
    """A loader of two fixed distributions, by the text's last word."""
    table = {"one": {"POSITIVE": 0.2, "NEUTRAL": 0.1, "NEGATIVE": 0.7}, "two": {"POSITIVE": 0.6, "NEUTRAL": 0.2, "NEGATIVE": 0.2}}

    def load():
        def batch(texts):
            assert isinstance(texts, list)
            return [table.get((t.split() or [""])[-1], {"POSITIVE": 0.0, "NEGATIVE": 0.0}) for t in texts]
        return batch

    return load


def test_batch_scores_and_paragraph_mean(spark):
    scorer = sentiment.ModelScorer(fixed_model())
    scored = {(r.goid, r.pos): r for r in sentiment.paragraph_scores(articles(spark), scorer).collect()}
    assert len(scored) == 3 and scored["1", 0].positive == 0.2 and scored["3", 0].neutral is None
    means = {r.goid: (r.positive, r.neutral, r.negative) for r in sentiment.paragraph_average(articles(spark), scorer).collect()}
    assert means == {"1": (0.4, 0.15, 0.45), "2": (0.0, 0.0, 0.0), "3": (0.0, 0.0, 0.0), "4": (0.0, 0.0, 0.0)}


def test_model_input_limit_is_optional(spark):
    def lengths():
        return lambda texts: [{"positive": len(t) / 1000} for t in texts]

    rows = spark.createDataFrame([("1", "x" * 600)], "goid string, t string")
    score = lambda **o: sentiment.ModelScorer(lengths, ["positive"], **o)(rows, "t", ["goid"]).first().positive
    assert score() == 0.6 and score(max_chars=512) == 0.511


def test_lexicon_table_equals_rule(spark):
    docs = spark.createDataFrame([(i, f"word{i} word{i + 1} common {'common ' * (i % 4)}") for i in range(60)] + [(99, "!"), (100, None)],
                                 "k bigint, t string")
    words = docs.select(F.explode(sentiment.text.tokens(F.col("t"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    lexicon = words.select("term", term_mark(F.col("term")).alias("mark"), "df").filter("mark <> 0")
    for classes in (2, 3):
        rule = sorted(map(tuple, sentiment.RuleScorer(term_mark, classes)(docs, "t", ["k"]).collect()))
        table = sorted(map(tuple, sentiment.LexiconScorer(lexicon, classes)(docs, "t", ["k"]).collect()))
        assert rule == table and len(rule) == 61


def test_title_step_keeps_existing_values(spark):
    rows = articles(spark).withColumn("roberta_title_positive", F.when(F.col("goid") == "1", 0.9))
    out = {r.goid: r for r in sentiment.title_step(rows, sentiment.RuleScorer(term_mark), ROBERTA_TITLE).collect()}
    assert out["1"].roberta_title_positive == 0.9 and out["1"].roberta_title_neutral is not None
    assert out["2"].roberta_title_neutral is None and len(out) == 4


def test_step_over_a_manifest_is_idempotent(spark):
    rows = articles(spark).withColumn("name", F.col("goid"))
    manifest = spark.createDataFrame([("1",), ("4",)], "name string")
    for scorer, title, paragraph in [(sentiment.RuleScorer(term_mark, 3), ROBERTA_TITLE, ROBERTA_PARAGRAPH),
                                     (sentiment.RuleScorer(term_mark, 2), BERT_TITLE, BERT_PARAGRAPH)]:
        once = steps.score_sentiment(rows, scorer, title, paragraph, manifest)
        got = {r.goid: r for r in once.collect()}
        column = paragraph["positive"]
        assert got["1"][column] > 0 and got["4"][column] == 0.0 and got["2"][column] is None
        twice = steps.score_sentiment(once, scorer, title, paragraph)
        assert {r.goid: r[column] for r in twice.collect()}["1"] == got["1"][column]


def test_article_sentiment(spark):
    out = {r.goid: r for r in sentiment.article_sentiment(articles(spark), sentiment.ModelScorer(fixed_model())).collect()}
    # plain mean over texts: (-0.5 / 0.9 + 0.4 / 0.8) / 2
    body = (-0.5 / 0.9 + 0.4 / 0.8) / 2
    assert abs(out["1"].body_polarity - body) < 1e-9 and abs(out["1"].sentiment - 0.8 * body) < 1e-9
    assert out["2"].sentiment == 0.0 and out["2"].title_polarity is None
    assert out["3"].body_polarity == 0.0 and out["3"].title_polarity is None
    assert out["4"].body_polarity is None and out["4"].sentiment == 0.0
