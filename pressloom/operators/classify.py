"""Economic-article classifier: training, scoring, selection and evaluation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..schema import STOP_WORDS
from ..session import materialise, shared_path, spread
from . import clean, tfidf
from .scale import lookup_join

FEATURES = 1000


def split_by_key(df: DataFrame, key: str, train_share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable split: a row's side depends on its key alone, on any cluster."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000))
    edge = int(train_share * 10_000)
    return df.filter(bucket < edge), df.filter(bucket >= edge)


def prepared(df: DataFrame, content: str, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """The token column the vectoriser reads. Cleaning a text first would change none of its tokens: what it takes away
    stands in no token."""
    return df.withColumn("terms", F.coalesce(tfidf.term_array(F.col(content), stop_words), F.array().cast("array<string>")))


def train(df: DataFrame, key: str = "goid", content: str = "text", section: str = "section",
          features: int = FEATURES, fit_on_all: bool = False, strict_reference: bool = False,
          stop_words: Iterable[str] = STOP_WORDS) -> tuple[PipelineModel, DataFrame]:
    """Fit bounded TF-IDF and a logistic regression; returns the model and the test rows.

    The vocabulary comes from the training rows; ``fit_on_all`` takes all rows. The penalty is
    1/n, i.e. unit strength on the summed loss.
    """
    # read by the counts, the vocabulary and the fit
    rows = materialise(clean.labelled_sections(df, section, content, strict_reference=strict_reference).select(
        key, "label", F.col("processed_text").alias("text")), "labelled")
    train_rows, test_rows = split_by_key(rows, key)
    vocabulary = tfidf.fit(rows if fit_on_all else train_rows, "text", stop_words, features, key)
    # at most ``features`` rows: the vectoriser needs its vocabulary on the driver
    terms = vocabulary.terms.orderBy("term").collect()
    if not terms:
        raise ValueError("no training rows with a known section")
    vectorise = CountVectorizerModel.from_vocabulary([r.term for r in terms], inputCol="terms", outputCol="counts")
    weigh = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in terms]), inputCol="counts", outputCol="weights")
    unit = Normalizer(p=2.0, inputCol="weights", outputCol="features")
    examples = train_rows.count()
    regression = LogisticRegression(
        labelCol="label", featuresCol="features", elasticNetParam=0.0, regParam=1.0 / examples, standardization=False, tol=1e-4,
    )
    fitted = Pipeline(stages=[vectorise, weigh, unit, regression]).fit(prepared(train_rows, "text", stop_words))
    # the stored model carries no training summary, which would travel with every task
    path = shared_path(df.sparkSession, "classifier")
    fitted.save(path)
    return PipelineModel.load(path), test_rows


def score(df: DataFrame, model: PipelineModel, content: str = "text", name: str = "is_economic",
          stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """Add the probability, rounded to 4; null where the text is null. No shuffle; a filter on it does not run the model again."""
    scored = model.transform(prepared(df, content, stop_words))
    probability = F.round(vector_to_array("probability")[1], 4)
    return scored.select(*df.columns, F.explode(F.array(F.when(F.col(content).isNotNull(), probability))).alias(name))


def score_with_coefficients(docs: DataFrame, model: tfidf.TfidfModel, coefficients: DataFrame, intercept: float,
                            key: str = "goid", content: str = "text", name: str = "is_economic") -> DataFrame:
    """The same probability from a (term, coefficient) table of bounded size, without an ML model.

    Terms are counted within their row and meet the small vocabulary by broadcast, so each task adds up its own documents
    and the shuffle holds two sums a document.
    """
    terms = model.terms.select("term", "idf").join(coefficients.select("term", "coefficient"), "term", "left")
    rows = spread(docs.select(key, content), key).select(key, F.inline(text.term_counts(tfidf.term_array(F.col(content), STOP_WORDS))))
    raw = F.col("n") * F.col("idf")
    sums = lookup_join(rows, materialise(terms, "coefficients"), "term").groupBy(key).agg(
        F.sum(raw * raw).alias("_square"), F.sum(raw * F.col("coefficient")).alias("_sum"))
    margins = sums.select(key, (F.col("_sum") / F.sqrt("_square")).alias("_margin"))
    # the text itself is not needed beside the margin
    docs = docs.withColumn("_there", F.col(content).isNotNull())
    margin = F.coalesce("_margin", F.lit(0.0)) + F.lit(intercept)
    probability = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)), 4)
    return (
        docs.join(margins, key, "left")
        .withColumn(name, F.when(F.col("_there"), probability))
        .drop("_margin", "_there")
    )


def classification_report(predictions: DataFrame, label: str = "label", probability: str = "probability",
                          threshold: float = 0.5) -> DataFrame:
    """Precision, recall, f1 and support per class, accuracy, macro and weighted averages.

    One confusion count over the data; everything after is arithmetic on its four numbers.
    Predictions are probability >= threshold.
    """
    actual, predicted = F.col(label) == 1, F.col(probability) >= threshold
    n = predictions.agg(
        F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom == 0, 0.0).otherwise(top / bottom)

    def row(name: str, hit: str, false: str, miss: str) -> Column:
        p = ratio(F.col(hit), F.col(hit) + F.col(false))
        r = ratio(F.col(hit), F.col(hit) + F.col(miss))
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
            ratio(2 * p * r, p + r).alias("f1"), (F.col(hit) + F.col(miss)).alias("support"),
        )

    both = n.select(row("0", "tn", "fn", "fp").alias("c0"), row("1", "tp", "fp", "fn").alias("c1"),
                    (F.col("tp") + F.col("tn")).alias("right"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("all"))

    def average(name: str, w0: Column, w1: Column) -> Column:
        def mean(field: str) -> Column:
            return ratio(F.col(f"c0.{field}") * w0 + F.col(f"c1.{field}") * w1, w0 + w1)
        return F.struct(F.lit(name).alias("class"), mean("precision").alias("precision"), mean("recall").alias("recall"),
                        mean("f1").alias("f1"), F.col("all").alias("support"))

    accuracy = ratio(F.col("right"), F.col("all"))
    rows = F.array(
        F.col("c0"), F.col("c1"),
        F.struct(F.lit("accuracy").alias("class"), accuracy.alias("precision"), accuracy.alias("recall"),
                 accuracy.alias("f1"), F.col("all").alias("support")),
        average("macro avg", F.lit(1.0), F.lit(1.0)),
        average("weighted avg", F.col("c0.support").cast("double"), F.col("c1.support").cast("double")),
    )
    return both.select(F.inline(rows))
