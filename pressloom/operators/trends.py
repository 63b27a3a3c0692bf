"""Salience-weighted sentiment and its trend tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import labels, salience as sal
from .clean import with_required


def salience_column() -> Column:
    """Salience from publisher (folded), date, page and word count."""
    page = sal.page_score(sal.normalize_page(F.col("page")))
    return sal.salience(sal.day_score(F.col("date")), page, F.col("word_count"), sal.page_size(F.col("publisher")))


def with_salience(articles: DataFrame, name: str = "salience_score") -> DataFrame:
    """Add the salience score; null where the article cannot be scored."""
    return articles.withColumn(name, salience_column())


def adjusted_sentiment(articles: DataFrame, sentiment: str = "bert_sentiment") -> DataFrame:
    """Keep scored rows and weight their sentiment by salience."""
    return with_required(articles, "salience_score", salience_column()).withColumn(
        "adjusted_sentiment", F.col(sentiment) * F.col("salience_score"))


def zscore(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Row-level (x - mean) / sample deviation over the whole table, ``{column: new name}``.

    The statistics are one scalar subquery, so there is no join and no unpartitioned window.
    """
    stats = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("mu"), F.stddev_samp(c).alias("sd")).alias(c) for c in columns
    ]).alias("s")).scalar()
    out = df.withColumn("_s", stats)
    for c, name in columns.items():
        out = out.withColumn(name, (F.col(c) - F.col(f"_s.{c}.mu")) / F.col(f"_s.{c}.sd"))
    return out.drop("_s")


def mean_zscore(df: DataFrame, columns: dict[str, str], keys: Sequence[Column]) -> DataFrame:
    """Group means of z-scores in one pass over the data.

    The mean of (x - mu) / sd is (mean - mu) / sd, so groups keep (n, mean, m2) and the overall
    deviation follows from those few rows.
    """
    groups = df.groupBy(*keys).agg(*[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2")).alias(f"_{c}")
        for c in columns
    ])
    # one row per group from here on, so the frame below holds as many rows as there are groups
    every = W.partitionBy(F.lit(0))
    out = groups
    for c, name in columns.items():
        n, mean = F.col(f"_{c}.n"), F.col(f"_{c}.mean")
        out = out.withColumn("_n", F.sum(n).over(every)).withColumn("_mu", F.sum(n * mean).over(every) / F.col("_n"))
        m2 = F.sum(F.col(f"_{c}.m2") + n * (mean - F.col("_mu")) * (mean - F.col("_mu"))).over(every)
        out = out.withColumn("_sd", F.sqrt(m2 / (F.col("_n") - 1))).withColumn(name, (mean - F.col("_mu")) / F.col("_sd"))
    return out.drop("_n", "_mu", "_sd", *[f"_{c}" for c in columns])


def means_by(df: DataFrame, keys: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Group means; rows without a key are left out."""
    named = df.select(*keys, *values)
    names = named.columns[: len(keys)]
    return named.dropna(subset=names).groupBy(*names).agg(*[F.avg(v).alias(v) for v in values])


def counts_by(df: DataFrame, keys: Sequence[Column], name: str = "count") -> DataFrame:
    """Group sizes; rows without a key are left out."""
    named = df.select(*keys)
    return named.dropna().groupBy(*named.columns).agg(F.count(F.lit(1)).alias(name))


def label_counts(df: DataFrame, scores: dict[str, str], keys: Sequence[Column]) -> DataFrame:
    """Counts per key and sentiment label for several score columns, ``{column: count name}``.

    One pass: each row contributes one (label, source) pair per score. A label that one score never
    takes has a null count there, as an outer join of separate counts would give.
    """
    pairs = F.array(*[F.struct(labels.sentiment_label(F.col(c)).alias("label"), F.lit(n).alias("source")) for c, n in scores.items()])
    rows = df.select(*keys, F.explode(pairs).alias("_p")).select("*", "_p.label", "_p.source").drop("_p").dropna()
    names = [c for c in rows.columns if c != "source"]
    return rows.groupBy(*names).agg(*[
        F.nullif(F.count_if(F.col("source") == n), F.lit(0)).alias(n) for n in scores.values()
    ])


def long_counts(wide: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Unpivot count columns; null counts stay."""
    return wide.unpivot(list(ids), list(values), "count_type", "count")


def share_of_ones(df: DataFrame, flag: str, keys: Sequence[Column], name: str = "ratio") -> DataFrame:
    """ones / (zeros + ones) per key; null when either side is missing."""
    named = df.select(*keys, F.col(flag).alias("_f"))
    names = named.columns[:-1]
    ones, zeros = F.count_if(F.col("_f") == 1), F.count_if(F.col("_f") == 0)
    return named.dropna().groupBy(*names).agg(F.when((ones > 0) & (zeros > 0), ones / (zeros + ones)).alias(name))


def counts_above(df: DataFrame, column: str, thresholds: Sequence[int], keys: Sequence[Column]) -> DataFrame:
    """Rows per key above each threshold, strictly, in one scan."""
    named = df.select(*keys, F.col(column).alias("_v"))
    names = named.columns[:-1]
    return named.dropna(subset=names).groupBy(*names).agg(*[F.count_if(F.col("_v") > t).alias(f"above_{t}") for t in thresholds])
