"""Sentiment scoring behind one contract, and article-level aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import labels, text
from ..session import materialise
from .scale import lookup_join
from .upsert import set_columns

LABELS = ("negative", "neutral", "positive")


def distribution(positive: Column, negative: Column, neutral: Column, classes: int = 3) -> dict[str, Column]:
    """Smoothed label shares of token counts, rounded to 4 digits."""
    if classes == 2:
        total = positive + negative + 2
        return {"negative": F.round((negative + 1) / total, 4), "positive": F.round((positive + 1) / total, 4)}
    total = positive + negative + neutral + 3
    return {
        "negative": F.round((negative + 1) / total, 4),
        "neutral": F.round((neutral + 1) / total, 4),
        "positive": F.round((positive + 1) / total, 4),
    }


@dataclass
class RuleScorer:
    """Scores tokens by a column rule term -> 1, -1 or 0. Runs inside the row: no join, no shuffle."""

    rule: Callable[[Column], Column]
    classes: int = 3

    def __call__(self, df: DataFrame, text_col: str, key_cols: Sequence[str]) -> DataFrame:
        counts = text.let(F.transform(text.tokens(F.col(text_col)), self.rule), lambda marks: F.struct(
            F.size(F.filter(marks, lambda m: m == 1)).alias("p"),
            F.size(F.filter(marks, lambda m: m == -1)).alias("m"), F.size(marks).alias("all")))
        # null texts go with the explode: a filter would sink below and build the text a second time
        counted = df.select(*key_cols, F.explode(F.when(F.col(text_col).isNotNull(), F.array(counts))).alias("_c"))
        p, m = F.col("_c.p"), F.col("_c.m")
        shares = distribution(p, m, F.col("_c.all") - p - m, self.classes)
        return counted.select(*key_cols, *[c.alias(k) for k, c in shares.items()])


@dataclass
class LexiconScorer:
    """Scores tokens by a word table (term, mark); terms outside the table are neutral."""

    lexicon: DataFrame
    classes: int = 3

    def __call__(self, df: DataFrame, text_col: str, key_cols: Sequence[str]) -> DataFrame:
        keys = list(key_cols)
        # words are counted within their text; only keys and counts are written and moved
        rows = df.filter(F.col(text_col).isNotNull()).select(*keys, F.inline_outer(text.term_counts(text.tokens(F.col(text_col)))))
        # most frequent words are neutral, so the lexicon lacks them
        marked = lookup_join(materialise(rows, "term-counts"), self.lexicon.select("term", "mark"), "term", how="left", absent=True)

        def tokens_with(mark: Column) -> Column:
            return F.coalesce(F.sum(F.when(mark, F.col("n"))), F.lit(0))

        counts = marked.groupBy(*keys).agg(
            tokens_with(F.col("mark") == 1).alias("_p"), tokens_with(F.col("mark") == -1).alias("_m"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("_all"),
        )
        shares = distribution(F.col("_p"), F.col("_m"), F.col("_all") - F.col("_p") - F.col("_m"), self.classes)
        return counts.select(*keys, *[c.alias(k) for k, c in shares.items()])


@dataclass
class ModelScorer:
    """Scores with any Python model. ``load`` runs once per task and returns
    ``batch(list[str]) -> list[dict[label, probability]]``; texts travel in Arrow batches.

    Texts above ``max_chars`` are cut to one character less, the input limit of transformer models;
    None sends whole texts.
    """

    load: Callable[[], Callable[[list[str]], list[Mapping[str, float]]]]
    classes: Sequence[str] = LABELS
    max_chars: int | None = None

    def __call__(self, df: DataFrame, text_col: str, key_cols: Sequence[str]) -> DataFrame:
        keys, classes, load = list(key_cols), list(self.classes), self.load
        body = F.col(text_col) if self.max_chars is None else text.cut(F.col(text_col), self.max_chars, self.max_chars - 1)
        source = df.filter(F.col(text_col).isNotNull()).select(*keys, body.alias("_text"))
        schema = T.StructType([*source.select(*keys).schema, *[T.StructField(c, T.DoubleType()) for c in classes]])
        rounded = [F.round(c, 4).alias(c) for c in classes]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                found = [{k.lower(): v for k, v in d.items()} for d in model(batch["_text"].tolist())]
                out = batch[keys].copy()
                for c in classes:
                    out[c] = pd.Series([d.get(c) for d in found], index=out.index, dtype="float64")
                yield out

        return source.mapInPandas(run, schema).select(*keys, *rounded)


Scorer = Callable[[DataFrame, str, Sequence[str]], DataFrame]


def score_texts(df: DataFrame, text_col: str, key_cols: Sequence[str], scorer: Scorer) -> DataFrame:
    """(keys, negative[, neutral], positive): one row per non-null text."""
    return scorer(df, text_col, key_cols)


def paragraph_scores(articles: DataFrame, scorer: Scorer, key: str = "goid", paragraphs: str = "paragraph_text") -> DataFrame:
    """(key, pos, labels...): one scored row per paragraph.

    The coalesce keeps Spark from adding a size filter below, which would build the paragraphs twice.
    """
    filled = F.coalesce(paragraphs, F.array().cast("array<string>"))
    rows = articles.select(key, F.posexplode(filled).alias("pos", "_paragraph"))
    return scorer(rows, "_paragraph", [key, "pos"])


def paragraph_average(articles: DataFrame, scorer: Scorer, key: str = "goid", paragraphs: str = "paragraph_text") -> DataFrame:
    """Mean label share over an article's paragraphs, rounded to 4; zeros when it has none.

    Shares have four digits, so they are summed as whole ten-thousandths: the mean does not depend on
    the order in which tasks deliver rows, and halves always round up.
    """
    scored = paragraph_scores(articles, scorer, key, paragraphs)
    present = [c for c in LABELS if c in scored.columns]
    units = [F.coalesce(F.sum(F.round(F.col(c) * 10_000).cast("long")), F.lit(0)).alias(c) for c in present]
    sums = scored.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *units)

    def mean(c: str) -> Column:
        return F.floor((F.col(c) * 2 + F.col("_n")) / (F.col("_n") * 2)) / F.lit(10_000.0)

    return articles.select(key).join(sums, key, "left").select(
        key, *[F.coalesce(mean(c), F.lit(0.0)).alias(c) if c in present else F.lit(0.0).alias(c) for c in LABELS])


def title_step(articles: DataFrame, scorer: Scorer, columns: Mapping[str, str], key: str = "goid", title: str = "title") -> DataFrame:
    """Add title sentiment columns; existing values stay."""
    return set_columns(articles, score_texts(articles, title, [key], scorer), columns, key, modify=False)


def paragraph_step(articles: DataFrame, scorer: Scorer, columns: Mapping[str, str], key: str = "goid",
                   paragraphs: str = "paragraph_text") -> DataFrame:
    """Add averaged paragraph sentiment columns; existing values stay."""
    return set_columns(articles, paragraph_average(articles, scorer, key, paragraphs), columns, key, modify=False)


def list_polarity(scored: DataFrame, key: str = "goid", name: str = "polarity") -> DataFrame:
    """Plain mean polarity over an article's scored texts."""
    return scored.groupBy(key).agg(F.avg(labels.polarity(F.col("positive"), F.col("negative"))).alias(name))


def article_sentiment(articles: DataFrame, scorer: Scorer, key: str = "goid", title: str = "title",
                      paragraphs: str = "paragraph_text") -> DataFrame:
    """(key, title_polarity, body_polarity, sentiment). A part that is missing or has no text is left out;
    a part without words scores zero."""
    titles = list_polarity(score_texts(articles, title, [key], scorer), key, "_title")
    bodies = list_polarity(paragraph_scores(articles, scorer, key, paragraphs), key, "_body")
    has_words = F.exists(paragraphs, lambda p: p.rlike(r"\S"))
    shape = articles.select(
        key, (F.length(title) > 0).alias("_titled"), ((F.size(paragraphs) > 0) & ~has_words).alias("_wordless"))
    return (
        shape.join(titles, key, "left").join(bodies, key, "left")
        .select(key, F.when(F.col("_titled"), F.col("_title")).alias("title_polarity"),
                F.when(F.col("_wordless"), 0.0).otherwise(F.col("_body")).alias("body_polarity"))
        .withColumn("sentiment", labels.article_polarity(F.col("title_polarity"), F.col("body_polarity")))
    )
