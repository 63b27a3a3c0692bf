"""Row cleaning, filters, set operations and lookups on article tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import labels, text
from ..schema import (
    ECONOMIC_SECTIONS, ECONOMIC_TAGS_INDEXED, ECONOMIC_TAGS_OBSERVED, EXCLUDED_PUBLISHER,
    OTHER_SECTIONS, PUBLISHER_ALIASES,
)
from .scale import first_per_key, lookup_join


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Append tables whose columns may differ; absent ones become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fold_publishers(df: DataFrame, column: str = "publisher", aliases: Mapping[str, str] = PUBLISHER_ALIASES) -> DataFrame:
    return df.withColumn(column, labels.publisher_key(F.col(column), aliases))


def exclude_publisher(df: DataFrame, name: str = EXCLUDED_PUBLISHER, column: str = "publisher") -> DataFrame:
    """Drop one publisher; rows without a publisher stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(name)))


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows with a null in any of the columns."""
    return df.dropna(subset=list(columns))


def with_required(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column and drop rows where it is null, computing it once per row.

    A filter on the column would be pushed below it, with a second copy of its expression.
    """
    return df.select("*", F.explode(F.filter(F.array(value), lambda v: v.isNotNull())).alias(name))


def years(df: DataFrame, after: int | None = None, before: int | None = None, column: str = "date") -> DataFrame:
    """after < year < before, as date bounds that reach the scan."""
    if after is not None:
        df = df.filter(F.col(column) >= F.lit(f"{after + 1:04d}-01-01").cast("date"))
    if before is not None:
        df = df.filter(F.col(column) < F.lit(f"{before:04d}-01-01").cast("date"))
    return df


def distinct_by_key(df: DataFrame, key: str = "goid", order: Sequence[str] = ("date",)) -> DataFrame:
    """One row per key, first in ``order``; rows that tie are ordered by a hash of all their columns."""
    return first_per_key(df, [key], [*order, F.xxhash64(*df.columns)])


def distinct_by_text(df: DataFrame, content: Column, order: Sequence[str] = ("date", "goid")) -> DataFrame:
    """One row per text, earliest first; the hash is dropped again."""
    return first_per_key(df.withColumn("_hash", F.md5(content)), ["_hash"], [*order, F.xxhash64(*df.columns)]).drop("_hash")


def pending(wanted: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """Wanted rows not done yet; repeated names stay."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def listed(df: DataFrame, manifest: DataFrame, key: str = "name") -> DataFrame:
    """Rows whose key is in the manifest."""
    return df.join(manifest.select(key).distinct(), key, "left_semi")


def economic_tags(spark: SparkSession) -> DataFrame:
    """Both subject lists, lower-cased, merged and made distinct (about 130 rows)."""
    def tags(values: Iterable[str]) -> DataFrame:
        return spark.createDataFrame([(v,) for v in values], "tag string").select(F.lower("tag").alias("tag"))
    return tags(ECONOMIC_TAGS_INDEXED).union(tags(ECONOMIC_TAGS_OBSERVED)).distinct()


def with_tags(df: DataFrame, tags: DataFrame, column: str, case_insensitive: bool = False, keep: bool = True) -> DataFrame:
    """Rows whose tag is (``keep``) or is not in the tag list; tags are compared as written unless asked."""
    value = F.lower(F.col(column)) if case_insensitive else F.col(column)
    return df.join(F.broadcast(tags), value == tags["tag"], "left_semi" if keep else "left_anti")


def section_label(section: Column, strict_reference: bool = False) -> Column:
    """1 economic, 0 other, null unknown, from a newspaper section.

    Sections are cleaned before the comparison, so the label sets are cleaned alike;
    ``strict_reference`` compares with the sets as written, where entries with punctuation never match.
    """
    classes = {ECONOMIC_SECTIONS: 1, OTHER_SECTIONS: 0}
    sets = F.create_map(*[
        x for names, label in classes.items() for n in names
        for x in ((F.lit(n) if strict_reference else text.clean_text(F.lit(n))), F.lit(label))
    ])
    return F.try_element_at(sets, text.clean_text(section))


def labelled_sections(df: DataFrame, section: str = "section", content: str = "text",
                      min_length: int = 40, strict_reference: bool = False) -> DataFrame:
    """Training rows: known section, text of at least ``min_length`` cleaned characters."""
    known = df.withColumn("label", section_label(F.col(section), strict_reference)).filter(F.col("label").isNotNull())
    long_enough = text.let(text.clean_text(F.col(content)), lambda t: F.when(F.length(t) >= min_length, t))
    return with_required(known.drop("processed_text"), "processed_text", long_enough)


def lemmatise(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace ``term`` by its lemma; unknown terms, which may be the most frequent ones, stay. ``lemmas`` has (term, lemma)."""
    joined = lookup_join(tokens, lemmas.select("term", "lemma"), "term", how="left", absent=True)
    return joined.withColumn("term", F.coalesce("lemma", "term")).drop("lemma")
