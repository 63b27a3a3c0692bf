"""Dates, classes, publisher names and sentiment arithmetic as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from ..schema import PUBLISHER_ALIASES


def quarter_label(date: Column) -> Column:
    """``2014Q2``."""
    return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))


def weekday_name(text: Column) -> Column:
    """Weekday of a ``yyyy-MM-dd`` text; null when it is not such a date."""
    return F.date_format(iso_date(text), "EEEE")


def iso_date(text: Column) -> Column:
    well_formed = text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
    return F.when(well_formed, F.try_to_date(text, "yyyy-M-d"))


def sentiment_label(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score > 0.5, "positive")
        .when(score < -0.5, "negative")
        .otherwise("neutral")
    )


def size_class(words: Column) -> Column:
    return (
        F.when(words.isNull(), F.lit(None).cast("string"))
        .when(words < 300, "small")
        .when(words > 1000, "large")
        .otherwise("medium")
    )


def above_threshold(probability: Column, threshold: float) -> Column:
    """Strictly above; anything that is not a number is below."""
    value = probability.cast("string").try_cast("double")
    return F.coalesce((value > threshold) & ~F.isnan(value), F.lit(False))


def publisher_key(publisher: Column, aliases: Mapping[str, str] = PUBLISHER_ALIASES) -> Column:
    """Lower-cased publisher with known aliases folded; the alias table is fixed and tiny."""
    name = F.lower(publisher)
    mapping = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, name), name)


def polarity(positive: Column, negative: Column) -> Column:
    """(pos - neg) / (pos + neg), zero when both are zero, null when either is."""
    total = positive + negative
    return F.when(total == 0, 0.0).otherwise((positive - negative) / total)


def article_polarity(title: Column, body: Column, title_weight: float = 0.2, body_weight: float = 0.8) -> Column:
    """Weighted title and body polarity over the parts that exist; zero when neither does."""
    weight = F.when(title.isNotNull(), title_weight).otherwise(0.0) + F.when(body.isNotNull(), body_weight).otherwise(0.0)
    total = F.coalesce(title * title_weight, F.lit(0.0)) + F.coalesce(body * body_weight, F.lit(0.0))
    return F.when(weight == 0, 0.0).otherwise(total / weight)
