"""Page rules against hand-made rows and a row-by-row model of them."""

import itertools
from datetime import date

import pytest
from pyspark.sql import functions as F

from pressloom.functions import salience as sal
from pressloom.operators import trends

KNOWN = {
    "A.01": ("1.a", 1.0), "b.2": ("2.b", 0.8), "T.04": ("4.t", 0.5), "SP.4": ("4.sp", 0.5), "07": ("7", 0.5),
    "1": ("1", 0.8), "A01": ("01.a", 1.0), "A": ("a", 0.7), "d": ("d", None), "3.part.b": ("3", 0.6),
    "a.part.b": (None, None), ".": (None, None), "123": (None, None), "0": (None, None), "a.b": ("a.b", None),
    "1.2": ("1.2", 0.8), "a0": ("0.a", 0.7), "a00": ("00.a", 0.7), "10.2": ("10.2", 0.5), "c": ("c", 0.6),
}


def model(page):
    """Rules spelled out one row at a time."""
    if page is None:
        return None, None
    p = page.lower()
    if p.strip() == ".":
        return None, None

    def bare(x):
        return x.lstrip("0") if x.isdigit() else x

    bits = p.split(".")
    if len(bits) == 1:
        if len(p) == 1 and p.isalnum():
            norm = bare(p)
        elif len(p) == 2:
            norm = bare(p) if p.isdigit() else ".".join(sorted(p))
        elif len(p) == 3 and p[0].isalpha() and p[1:].isdigit():
            norm = ".".join(sorted([p[0], p[1:]]))
        else:
            norm = None
    elif len(bits) == 2:
        norm = ".".join(sorted(map(bare, bits)))
    else:
        norm = bare(bits[0]) if bits[1] == "part" and bits[0].isdigit() else None
    if not norm:
        return None, None
    if "." in norm:
        left, right = norm.split(".")[:2]
        try:
            number, letter = int(left), right
        except ValueError:
            return norm, None
    else:
        number, letter = (int(norm), None) if norm.isdigit() else (None, norm)
    table = {"a": (1.0, 0.9, 0.8, 0.7), "b": (0.9, 0.8, 0.7, 0.6), "c": (0.9, 0.8, 0.7, 0.6)}.get(letter)
    if table is None:
        if number is None:
            return norm, None
        table = (0.8, 0.7, 0.6, 0.5)
    return norm, table[number - 1] if number in (1, 2, 3) else table[3]


def scored(spark, pages):
    rows = spark.createDataFrame([(p,) for p in pages], "page string")
    out = rows.withColumn("n", sal.normalize_page(F.col("page"))).withColumn("s", sal.page_score(F.col("n")))
    return {r.page: (r.n, r.s) for r in out.collect()}


def test_known_pages(spark):
    assert scored(spark, KNOWN) == KNOWN


def test_pages_match_the_row_model(spark):
    alphabet = "aBd012.x-"
    pages = ["".join(t) for n in (1, 2, 3, 4) for t in itertools.product(alphabet, repeat=n)]
    pages += ["1.part.a", "01.part", "x.part.1", "3.part..", "SPORT.12", "a.1.2", "A.001", None]
    got = scored(spark, pages)
    assert {p: v for p, v in got.items() if v != model(p)} == {}


@pytest.mark.parametrize("words,expected", [(1188, 1.0), (5000, 1.0), (594, 0.75), (None, None)])
def test_salience_by_length(spark, words, expected):
    row = spark.createDataFrame([("new york times", date(2010, 5, 16), "A.1", words)], "publisher string, date date, page string, word_count int")
    assert trends.with_salience(row).first().salience_score == expected


def test_weekday_and_unknown_publisher(spark):
    rows = spark.createDataFrame([
        ("usa today", date(2010, 5, 15), "A.1", 2000), ("usa today", date(2010, 5, 14), "A.1", 2000),
        ("jerusalem post", date(2010, 5, 14), "A.1", 2000), ("usa today", None, "A.1", 2000),
    ], "publisher string, date date, page string, word_count int")
    assert [r.salience_score for r in trends.with_salience(rows).collect()] == [0.9, 0.8, None, None]


def test_group_means_equal_row_means(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.sin("id") * 100 + 1e6).alias("x"))
    by_row = trends.zscore(rows, {"x": "z"}).groupBy("g").agg(F.avg("z").alias("z"))
    by_group = trends.mean_zscore(rows, {"x": "z"}, [F.col("g")])
    a, b = ({r.g: r.z for r in df.collect()} for df in (by_row, by_group))
    assert a.keys() == b.keys() and all(abs(a[g] - b[g]) < 1e-9 for g in a)
