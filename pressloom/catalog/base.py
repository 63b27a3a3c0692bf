"""Registry, table readers and the article tables derived from ``documents``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Article columns as functions of doc_id, in the words both engines share.
_PUBLISHER = """CASE doc_id % 8 WHEN 0 THEN 'New York Times' WHEN 1 THEN 'International Herald Tribune' WHEN 2 THEN 'USA TODAY'
 WHEN 3 THEN 'Washington Post The' WHEN 4 THEN 'Los Angeles Times (pre-1997 Fulltext)' WHEN 5 THEN 'Chicago Tribune'
 WHEN 6 THEN 'New York Times Español' ELSE 'Jerusalem Post' END"""
_PAGE = """CASE WHEN doc_id % 17 = 0 THEN '.' WHEN doc_id % 17 = 1 THEN 'A01' WHEN doc_id % 17 = 2 THEN '07'
 WHEN doc_id % 17 = 3 THEN '3.part.b' WHEN doc_id % 17 = 4 THEN 'SP.4' WHEN doc_id % 17 = 5 THEN NULL
 ELSE concat(substr('ABCDET', CAST(1 + doc_id % 6 AS INT), 1), '.', lpad(CAST(1 + doc_id % 23 AS {string}), 2, '0')) END"""
_BERT = "round((doc_id * 7919 % 2001 - 1000) / 1000.0E0, 3)"
_ECONOMIC = "round((doc_id * 37 % 1000) / 1000.0E0, 3)"
_SECTION = """CASE WHEN doc_id % 13 = 0 THEN 'Finance/Business' WHEN doc_id % 13 = 1 THEN 'Metro'
 WHEN doc_id % 13 < 6 THEN 'Arts & Entertainment' ELSE 'Money' END"""
_TAGS = ("Banks", "inflation", "Sports", "Budgets", "arts", "prices")
_TAG = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAGS)) + " END"

# DuckDB form; ``lines`` are the document's stripped lines.
ARTICLES = f"""articles AS (
 SELECT doc_id AS goid, text, {_PUBLISHER} AS publisher,
 DATE '2002-01-01' + CAST(doc_id * 29 % 8766 AS INT) AS date, {_PAGE.format(string='VARCHAR')} AS page,
 len(regexp_extract_all(text, '[^ \\n\\t\\r]+')) AS word_count, {_BERT} AS bert_sentiment, {_ECONOMIC} AS is_economic,
 {_SECTION} AS section, {_TAG} AS tag, lang
 FROM documents)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles derived from every document."""
    # word counts are derived here, so the texts are spread before they are read
    return spread(documents(spark, sf_dir).select("doc_id", "text", "lang"), "doc_id").select(
        F.col("doc_id").alias("goid"), "text", F.expr(_PUBLISHER).alias("publisher"),
        F.expr("date_add(DATE'2002-01-01', CAST(doc_id * 29 % 8766 AS INT))").alias("date"),
        F.expr(_PAGE.format(string="STRING")).alias("page"),
        F.regexp_count("text", F.lit(r"[^ \n\t\r]+")).alias("word_count"),
        F.expr(_BERT).alias("bert_sentiment"), F.expr(_ECONOMIC).alias("is_economic"),
        F.expr(_SECTION).alias("section"), F.expr(_TAG).alias("tag"), "lang",
    )


# DuckDB forms of the text functions.
def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


LINES_SQL = f"list_transform(string_split(text, chr(10)), lambda l: {strip_sql('l')})"


def valid_sql(x: str) -> str:
    return (
        rf"list_transform(list_filter({x}, lambda p: NOT contains(p, '@') AND len(regexp_extract_all(p, '\S+')) >= 2"
        r" AND NOT contains(lower(p), 'credit:')), lambda p: lower(p))"
    )


def clean_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a title (first line) and the valid paragraphs of the whole text."""
    lines = text.text_paragraphs(F.col("text"))
    return (
        articles(spark, sf_dir)
        .withColumn("title", lines[0])
        .withColumn("paragraph_text", text.valid_paragraphs(lines))
    )


TITLED = f"""{ARTICLES}, titled AS (
 SELECT * EXCLUDE (ps), CASE WHEN len(ps) > 0 THEN ps END AS paragraph_text FROM (
  SELECT *, ({LINES_SQL})[1] AS title, {valid_sql(LINES_SQL)} AS ps FROM articles))"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".xml")).alias("name"))


# Polarity rule of a term: the first hex digit of its MD5 marks 1/8 positive and 1/8 negative.
def term_mark(term):
    marks = F.create_map(*[F.lit(x) for pair in (("0", 1), ("1", 1), ("2", -1), ("3", -1)) for x in pair])
    return F.coalesce(F.try_element_at(marks, F.substring(F.md5(term), 1, 1)), F.lit(0))
