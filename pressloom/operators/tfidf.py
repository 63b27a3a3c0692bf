"""TF-IDF: fit, store, transform and top keywords."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..schema import STOP_WORDS
from ..session import materialise, spread
from .scale import frequent_rows


@dataclass
class TfidfModel:
    """Stored vocabulary: ``terms`` has (term, df, idf), one row per term."""

    terms: DataFrame
    documents: int

    def save(self, path: str) -> None:
        self.terms.withColumn("documents", F.lit(self.documents)).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TfidfModel":
        stored = spark.read.parquet(path)
        first = stored.select("documents").first()
        return TfidfModel(stored.drop("documents"), first[0] if first else 0)


def term_array(content: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    return text.without(text.tokens(content), stop_words)


def smooth_idf(documents: Column, df: Column) -> Column:
    return F.log((F.lit(1.0) + documents) / (F.lit(1.0) + df)) + 1.0


def plain_idf(documents: Column, df: Column) -> Column:
    """The textbook form log(N / df)."""
    return F.log(documents / df)


def document_frequencies(docs: DataFrame, content: str = "text", stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(term, df): documents per term, combined on the map side before the only shuffle."""
    terms = spread(docs.select(content)).select(
        F.explode(F.array_distinct(term_array(F.col(content), stop_words))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_totals(docs: DataFrame, key: str = "doc_id", content: str = "text",
                stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(term, tf, df): occurrences and documents per term, counted within each text first; no text is moved."""
    rows = spread(docs.select(content)).select(F.inline(text.term_counts(term_array(F.col(content), stop_words))))
    return rows.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def bounded_vocabulary(totals: DataFrame, size: int) -> DataFrame:
    """The ``size`` terms with the highest total count, ties by term."""
    return totals.orderBy(F.desc("tf"), "term").limit(size)


def fit(docs: DataFrame, content: str = "text", stop_words: Iterable[str] = STOP_WORDS,
        max_features: int | None = None, key: str = "doc_id", idf=smooth_idf) -> TfidfModel:
    """Learn the vocabulary; ``max_features`` keeps the terms with the highest total count."""
    documents = docs.count()
    if max_features is None:
        counts = document_frequencies(docs, content, stop_words)
    else:
        counts = bounded_vocabulary(term_totals(docs, key, content, stop_words), max_features)
    terms = counts.select("term", "df", idf(F.lit(float(documents)), F.col("df").cast("double")).alias("idf"))
    return TfidfModel(materialise(terms, "tfidf"), documents)


def term_rows(docs: DataFrame, key: str = "doc_id", content: str = "text",
              stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(key, term, tf), counted within each text; no text is moved."""
    counts = text.term_counts(term_array(F.col(content), stop_words))
    return spread(docs.select(key, content)).select(key, F.inline(counts)).withColumnRenamed("n", "tf")


# Text of a task that places documents: its (document, term) rows are sorted there, some ten times the size.
PLACED_BYTES = 16 << 20


def transform(docs: DataFrame, model: TfidfModel, key: str = "doc_id", content: str = "text",
              stop_words: Iterable[str] = STOP_WORDS, broadcast_limit: int | None = None) -> DataFrame:
    """One row per document: ``weights`` as (term, raw) structs and their L2 ``norm``; known terms only.

    Texts are placed by document, in parts small enough to be grouped in memory. Frequent terms are broadcast; a vocabulary
    beyond that is met by its rare terms' rows alone in a shuffle, and their weights come back to the documents.
    """
    read = docs.select(key, content)
    size = read.agg(F.sum(F.octet_length(F.col(content)))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PLACED_BYTES))
    words = read.repartition(parts, key).select(key, F.explode(term_array(F.col(content), stop_words)).alias("term"))
    rows = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))

    def grouped(met: DataFrame) -> DataFrame:
        # a group is one document's vocabulary, bounded by the row it came from
        raw = met.select(key, "term", (F.col("tf") * F.col("idf")).alias("raw"))
        return raw.groupBy(key).agg(F.sum(F.col("raw") * F.col("raw")).alias("square"), F.collect_list(F.struct("term", "raw")).alias("weights"))

    frequent = frequent_rows(model.terms, "df", broadcast_limit)
    if frequent is None:
        return grouped(rows.join(F.broadcast(model.terms), "term")).select(key, F.sqrt("square").alias("norm"), "weights")
    common = model.terms.filter(frequent)
    rare = rows.join(F.broadcast(common.select("term")), "term", "left_anti").join(model.terms.filter(~frequent), "term")
    a, b = grouped(rows.join(F.broadcast(common), "term")).alias("a"), grouped(rare.repartition(parts, key)).alias("b")
    none = F.array().cast(a.schema["weights"].dataType)
    return a.join(b, key, "full").select(
        key, F.sqrt(F.coalesce("a.square", F.lit(0.0)) + F.coalesce("b.square", F.lit(0.0))).alias("norm"),
        F.concat(F.coalesce("a.weights", none), F.coalesce("b.weights", none)).alias("weights"))


def scores(transformed: DataFrame, key: str = "doc_id", digits: int | None = None) -> DataFrame:
    """(key, term, score): L2-normalised weights in long form."""
    score = F.col("w.raw") / F.col("norm")
    return transformed.select(key, "norm", F.explode("weights").alias("w")).select(
        key, F.col("w.term").alias("term"), (score if digits is None else F.round(score, digits)).alias("score"),
    )


def keywords(transformed: DataFrame, top_n: int | None = 200, key: str = "doc_id", name: str = "tf_idf") -> DataFrame:
    """Per document the ``top_n`` (term, score) pairs, by falling unrounded weight, ties by term."""
    ranked = F.sort_array(F.transform("weights", lambda w: F.struct((-w["raw"]).alias("minus"), w["term"].alias("term"))))
    best = ranked if top_n is None else F.slice(ranked, 1, top_n)
    return transformed.select(key, F.transform(best, lambda w: F.struct(
        w["term"].alias("term"), F.round(-w["minus"] / F.col("norm"), 4).alias("score"),
    )).alias(name))
