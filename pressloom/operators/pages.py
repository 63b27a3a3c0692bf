"""Page statistics: how many words each printed page carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.salience import normalize_page
from ..session import materialise
from .scale import exact_quantiles

MIN_ARTICLES = 20


def valid_page(page: Column) -> Column:
    """No placeholder, at most two dot-separated parts."""
    return page.isNotNull() & ~F.lower(page).isin("asnap", "nan") & (F.size(F.split(page, "[.]")) <= 2)


def normalized_pages(articles: DataFrame) -> DataFrame:
    return (
        articles.filter(valid_page(F.col("page")))
        .withColumn("page", normalize_page(F.col("page")))
        .filter(F.col("page").isNotNull())
    )


def page_words(articles: DataFrame) -> DataFrame:
    """(date, page, words, articles)."""
    return articles.groupBy("date", "page").agg(
        F.sum("word_count").alias("words"), F.count("word_count").alias("articles"))


def weighted_words(daily: DataFrame) -> DataFrame:
    """(page, mean_words): daily word sums weighted by that day's articles."""
    return daily.groupBy("page").agg(
        (F.sum(F.col("words") * F.col("articles")) / F.sum("articles")).alias("mean_words"))


def page_counts(articles: DataFrame, minimum: int = MIN_ARTICLES) -> DataFrame:
    return articles.groupBy("page").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= minimum)


def page_stats(articles: DataFrame, minimum: int = MIN_ARTICLES) -> DataFrame:
    """(page, mean_words, count) of pages with enough articles. Both sides are one row per page."""
    return weighted_words(page_words(articles)).join(page_counts(articles, minimum), "page")


def publisher_page_size(stats: DataFrame) -> DataFrame:
    """Weighted mean, median and plain mean words per page, over the page table, which is written once for both passes."""
    stats = materialise(stats, "page-stats")
    middle = exact_quantiles(stats, "mean_words", [0.5])[0]
    return stats.agg(
        (F.sum(F.col("mean_words") * F.col("count")) / F.sum("count")).alias("weighted_mean"),
        F.lit(middle).cast("double").alias("median"), F.avg("mean_words").alias("plain_mean"),
    )


def value_counts(df: DataFrame, column: str, minimum: int = 1) -> DataFrame:
    """(column, count) of non-null values occurring at least ``minimum`` times."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") >= minimum)
