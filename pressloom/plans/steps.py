"""The corpus steps: select economic articles, tag keywords, score sentiment, analyse."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import labels, text
from ..operators import classify, clean, pages, sentiment, tfidf, trends, upsert
from ..operators.scale import lookup_join
from ..schema import ONLINE_ALIASES
from ..session import materialise
from ..sources import enrichment, tables
from ..streaming import commits, incremental


def selected_names(scored: DataFrame, threshold: float, probability: str = "is_economic", key: str = "goid") -> DataFrame:
    """(name) of articles strictly above the threshold."""
    above = scored.filter(labels.above_threshold(F.col(probability), threshold))
    return above.select(F.concat(F.col(key).cast("string"), F.lit(".xml")).alias("name"))


def select_economic(articles: DataFrame, model: PipelineModel, threshold: float = 0.5, key: str = "goid",
                    content: str = "text", name: str = "is_economic", del_grades: bool = False) -> tuple[DataFrame, DataFrame]:
    """Score every article, overwrite its probability and name those above the threshold.

    ``del_grades`` drops the tag of an earlier grading.
    """
    base = articles.drop(name, "grades") if del_grades else articles.drop(name)
    scored = classify.score(base, model, content, name)
    return scored, selected_names(scored, threshold, name, key)


def tag_keywords(articles: DataFrame, model: tfidf.TfidfModel, manifest: DataFrame | None = None, top_n: int = 200,
                 key: str = "goid", content: str = "text") -> DataFrame:
    """Keyword column for the articles of a manifest; existing keywords stay."""
    wanted = articles if manifest is None else clean.listed(articles, manifest)
    if "tf_idf" in wanted.columns:
        wanted = wanted.filter(F.col("tf_idf").isNull())
    words = tfidf.keywords(tfidf.transform(wanted, model, key, content), top_n, key)
    return upsert.set_columns(articles, words, ["tf_idf"], key, modify=False)


def score_sentiment(articles: DataFrame, scorer: sentiment.Scorer, title: Mapping[str, str], paragraph: Mapping[str, str],
                    manifest: DataFrame | None = None, key: str = "goid") -> DataFrame:
    """Title and paragraph label columns for the articles of a manifest, scored before any join back."""
    wanted = articles if manifest is None else clean.listed(articles, manifest)
    titles = sentiment.score_texts(wanted, "title", [key], scorer).select(
        key, *[F.col(label).alias(c) for label, c in title.items()])
    bodies = sentiment.paragraph_average(wanted, scorer, key).select(
        key, *[F.col(label).alias(c) for label, c in paragraph.items()])
    # only keys and label shares are joined; texts stay where they were scored
    scored = bodies.join(titles, key, "left")
    return upsert.set_columns(articles, scored, [*title.values(), *paragraph.values()], key, modify=False)


def enrich_sentiment(articles: DataFrame, scorer: sentiment.Scorer, title: Mapping[str, str], paragraph: Mapping[str, str],
                     path: str, manifest: DataFrame | None = None) -> str | None:
    """Score articles of (corpus, goid, title, paragraph_text) and commit the label columns as a version of the enrichment
    table at ``path``; existing values stay. Only keys and shares are joined, so no text leaves its place.

    A manifest of (corpus, goid) is broadcast while it is small; a longer one meets the articles in a shuffle.
    """
    wanted = articles.withColumn("_id", F.struct(*enrichment.KEYS))
    if manifest is not None:
        wanted = lookup_join(wanted, manifest.select(F.struct(*enrichment.KEYS).alias("_id")).distinct(), "_id", how="left_semi")
    titles = sentiment.score_texts(wanted, "title", ["_id"], scorer).select(
        "_id", *[F.col(label).alias(c) for label, c in title.items()])
    bodies = sentiment.paragraph_average(wanted, scorer, "_id").select(
        "_id", *[F.col(label).alias(c) for label, c in paragraph.items()])
    values = bodies.join(titles, "_id", "left").select("_id.*", *title.values(), *paragraph.values())
    return enrichment.write(materialise(values, "scores"), path, modify=False)


def run_selection(articles: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, progress: str, threshold: float = 0.5,
                  step: str = "economic", probability: str = "is_economic") -> tuple[dict, DataFrame]:
    """Economic selection as one resumable step over (corpus, name, text): pending articles are scored, and probability,
    choice and log are committed together. Articles without a text are errors. Returns counts and failures."""
    def choose(df: DataFrame) -> DataFrame:
        scored = score(df).select("corpus", "name", probability)
        return scored.withColumn("selected", labels.above_threshold(F.col(probability), threshold)).withColumn(
            "error", F.when(F.col(probability).isNull(), "no text"))

    return incremental.run_steps(articles, [(choose, {})], sink, progress, step)


def selection(spark: SparkSession, sink: str, progress: str, step: str = "economic", probability: str = "is_economic") -> DataFrame:
    """(corpus, name, probability, selected) of all committed runs; the manifest is where ``selected`` holds."""
    schema = f"corpus string, name string, {probability} double, selected boolean"
    return commits.read_rows(spark, sink, progress, step, schema).select("corpus", "name", probability, "selected")


def export_pending(articles: DataFrame, folder: str, progress: str, step: str = "export", rows: int = 2000) -> int:
    """Append the articles of (corpus, name, …) that the log does not hold as chunks of a folder, then log them.
    Returns how many chunks were written."""
    todo = materialise(incremental.still_pending(articles, incremental.read_progress(articles.sparkSession, progress, step)), "export")
    _, number = tables.append_chunks(todo, folder, ["corpus", "name"], rows)
    incremental.append_progress(todo.select("corpus", "name"), progress, step)
    return number


def analysed(articles: DataFrame, after: int | None = 2003, before: int | None = 2024) -> DataFrame:
    """Cleaned, de-duplicated, salience-weighted rows: the input of every trend table.

    Narrow filters come before the de-duplication's shuffle only where they cannot change its
    survivor: the publisher and date of a key's copies may differ, so those follow it.
    """
    rows = clean.distinct_by_key(articles)
    rows = clean.exclude_publisher(clean.fold_publishers(rows))
    rows = clean.years(clean.require(rows, "bert_sentiment", "page"), after, before)
    return trends.adjusted_sentiment(rows)


def quarterly_sentiment(articles: DataFrame) -> DataFrame:
    """Mean normalised sentiment, plain and salience-weighted, per quarter."""
    means = trends.mean_zscore(
        analysed(articles).select(labels.quarter_label(F.col("date")).alias("quarter"), "bert_sentiment", "adjusted_sentiment"),
        {"bert_sentiment": "normalized_sentiment", "adjusted_sentiment": "normalized_adjusted_sentiment"},
        [F.col("quarter")],
    )
    return means.select("quarter", "normalized_sentiment", "normalized_adjusted_sentiment")


def page_sizes(articles: DataFrame, aliases: Mapping[str, str] = ONLINE_ALIASES, minimum: int = pages.MIN_ARTICLES) -> DataFrame:
    """(page, mean_words, count): one row per article, publishers folded with their online editions, placeholder pages left
    out, pages with enough articles. Its rows go into ``tables.page_size_json`` and ``pages.publisher_page_size``."""
    rows = clean.exclude_publisher(clean.fold_publishers(clean.distinct_by_key(articles), aliases=aliases))
    return pages.page_stats(pages.normalized_pages(rows), minimum)


def described(articles: DataFrame) -> DataFrame:
    """Rows of the descriptive tables: year range, folded publishers, complete, distinct texts."""
    rows = clean.years(articles, 2003, 2024)
    rows = clean.exclude_publisher(clean.fold_publishers(rows))
    rows = clean.require(rows, "text", "page", "date", "word_count")
    return clean.distinct_by_text(rows, F.col("text"))


def document(title: str = "title", paragraphs: str = "paragraph_text", name: str = "doc"):
    """Title and body as one text column; rows without one of them are left out."""
    def add(df: DataFrame) -> DataFrame:
        return clean.with_required(df, name, text.title_and_body(F.col(title), F.col(paragraphs)))
    return add
