"""Connected components of an edge list, by alternating large-star and small-star rounds on Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.scale import lookup_join
from ..session import materialise


def _stars(edges: DataFrame, large: bool, limit: int) -> DataFrame:
    """One star round over (a, b) with a > b.

    Each vertex hands its neighbours on to the least vertex it knows. The least neighbours are an aggregate; a
    vertex with very many edges meets its own by broadcast (``lookup_join`` splits by degree).
    """
    if large:
        edges = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = materialise(edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least").withColumn(
        "m", F.least("m", "a"))
    met = lookup_join(edges, least, "a", "n", limit=limit)
    moved = met.filter(F.col("b") > F.col("a")) if large else met
    pairs = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        pairs = pairs.union(least.select("a", F.col("m").alias("b")))
    return pairs.filter(F.col("a") != F.col("b")).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, component) of every vertex that is not the least of its component.

    ``edges`` has columns (a, b); loops and repeated edges do no harm. Rounds follow the logarithm of the longest
    path; each ends in a written table.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialise(edges.select(high.alias("a"), low.alias("b")).filter("a != b").distinct(), "edges")
    mark = _print(now)
    while mark[0]:
        once = materialise(_stars(now, True, limit), "stars")
        now = materialise(_stars(once, False, limit), "stars")
        before, mark = mark, _print(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
