"""Salience: how prominently an article was printed, from page, weekday and length.

The page rules repeat their input in every branch; written out they outgrow a generated method, so
``let`` binds it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import DAY_SCORES, OTHER_DAY_SCORE, OTHER_PAGE_SCORES, PAGE_SCORES, PAGE_SIZES
from .text import let


def _bare_number(part: Column) -> Column:
    return F.when(part.rlike("^[0-9]+$"), F.ltrim(part, F.lit("0"))).otherwise(part)


def _parts(p: Column) -> Column:
    return (
        F.when(F.trim(p) == ".", None)
        .when(p.rlike(r"^([0-9]{1,2}|\p{L})$"), F.array(F.ltrim(p, F.lit("0"))))
        .when(p.rlike(r"^[^.]{2}$"), F.array_sort(F.array(F.substring(p, 1, 1), F.substring(p, 2, 1))))
        .when(p.rlike(r"^\p{L}[0-9]{2}$"), F.array(F.substring(p, 2, 2), F.substring(p, 1, 1)))
        .when(p.rlike(r"^[^.]*[.][^.]*$"), F.array_sort(F.transform(F.split(p, "[.]"), _bare_number)))
        .when(p.rlike(r"^[0-9]+[.]part[.]"), F.array(F.ltrim(F.split(p, "[.]")[0], F.lit("0"))))
    )


def normalize_page(page: Column) -> Column:
    """``A.01`` -> ``1.a``: one part, or two sorted parts (digits first); null when the tag is invalid."""
    joined = let(F.lower(page), lambda p: F.array_join(_parts(p), "."))
    return let(joined, lambda n: F.when(n != "", n))


def _score(parts: Column) -> Column:
    number, letter = parts[0].try_cast("bigint"), F.element_at(parts, -1)
    rank = F.when(number.between(1, 3), number.cast("int")).otherwise(4)
    scores = F.when(number.isNotNull(), F.array(*map(F.lit, OTHER_PAGE_SCORES)))
    for key, row in PAGE_SCORES.items():
        scores = F.when(letter == key, F.array(*map(F.lit, row))).otherwise(scores)
    # A lone a, b or c scores without a number; in a two-part tag the number is required.
    return F.when(number.isNotNull() | (F.size(parts) == 1), F.element_at(scores, rank))


def page_score(normalized: Column) -> Column:
    """Score of a normalised page tag; null where the tag carries no usable number."""
    return let(F.split(normalized, "[.]"), _score)


def day_score(date: Column) -> Column:
    return (
        F.when(date.isNull(), None)
        .when(F.dayofweek(date) == 1, DAY_SCORES["sunday"])
        .when(F.dayofweek(date) == 7, DAY_SCORES["saturday"])
        .otherwise(OTHER_DAY_SCORE)
    )


def page_size(publisher: Column) -> Column:
    """Words per page of a (folded) publisher; null when unknown."""
    sizes = F.create_map(*[F.lit(x) for pair in PAGE_SIZES.items() for x in pair])
    return F.try_element_at(sizes, publisher)


def salience(day: Column, page: Column, words: Column, size: Column) -> Column:
    """round(day * page * (2s - s^2), 3) with s = min(words / page size, 1); null when any part is.

    ``day`` and ``page`` are scores.
    """
    ratio = words.cast("double") / size
    curve = let(F.when(ratio > 1, 1.0).otherwise(ratio), lambda s: F.lit(2.0) * s - s * s)
    return F.round(day * page * curve, 3)
