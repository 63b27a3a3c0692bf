"""Filters, labels, derived columns, joins on keys, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, salience as sal
from ..operators import clean, pages, scale
from ..schema import (
    ECONOMIC_TAGS_INDEXED, ECONOMIC_TAGS_OBSERVED, ONLINE_ALIASES, PAGE_SIZES, PUBLISHER_ALIASES,
)
from ..session import shared_path
from ..sources import tables
from .base import ARTICLES, articles, clean_sql, documents, names, query, quoted, table


def alias_sql(column: str, aliases: dict = PUBLISHER_ALIASES) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in aliases.items())
    return f"CASE lower({column}) {cases} ELSE lower({column}) END"


@query("publisher_alias", f"WITH {ARTICLES} SELECT goid, {alias_sql('publisher')} AS publisher FROM articles")
def publisher_alias(spark, sf):
    return clean.fold_publishers(articles(spark, sf).select("goid", "publisher"))


@query("publisher_alias_online", f"""WITH {ARTICLES} SELECT goid,
 {alias_sql("CASE WHEN goid % 2 = 0 AND publisher = 'USA TODAY' THEN 'USA Today (Online)' ELSE publisher END", ONLINE_ALIASES)} AS publisher
 FROM articles""")
def publisher_alias_online(spark, sf):
    online = F.when((F.col("goid") % 2 == 0) & (F.col("publisher") == "USA TODAY"), "USA Today (Online)").otherwise(F.col("publisher"))
    return clean.fold_publishers(articles(spark, sf).select("goid", online.alias("publisher")), aliases=ONLINE_ALIASES)


@query("exclude_publisher", f"""WITH {ARTICLES} SELECT goid, lower(publisher) AS publisher FROM articles
 WHERE lower(publisher) IS DISTINCT FROM 'new york times español'""")
def exclude_publisher(spark, sf):
    return clean.exclude_publisher(clean.fold_publishers(articles(spark, sf).select("goid", "publisher"), aliases={"": ""}))


@query("require_columns", f"WITH {ARTICLES} SELECT goid, page FROM articles WHERE page IS NOT NULL AND bert_sentiment IS NOT NULL")
def require_columns(spark, sf):
    return clean.require(articles(spark, sf).select("goid", "page", "bert_sentiment"), "page", "bert_sentiment").select("goid", "page")


@query("year_range", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders
 WHERE year(o_orderdate) > 1996 AND year(o_orderdate) < 2000""")
def year_range(spark, sf):
    rows = clean.years(table(spark, sf, "orders"), 1996, 2000, "o_orderdate")
    return rows.select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))


@query("year_single_bounds", f"WITH {ARTICLES} SELECT goid, date FROM articles WHERE year(date) > 2003 AND year(date) < 2024")
def year_single_bounds(spark, sf):
    return clean.years(clean.years(articles(spark, sf).select("goid", "date"), after=2003), before=2024)


@query("probability_threshold", f"""WITH {ARTICLES}, p AS (SELECT goid,
 CASE goid % 11 WHEN 0 THEN NULL WHEN 1 THEN 'None' ELSE CAST(is_economic AS VARCHAR) END AS value FROM articles)
 SELECT goid, coalesce(TRY_CAST(value AS DOUBLE) > 0.2, false) AS selected FROM p""")
def probability_threshold(spark, sf):
    value = F.expr("CASE goid % 11 WHEN 0 THEN NULL WHEN 1 THEN 'None' ELSE CAST(is_economic AS STRING) END")
    return articles(spark, sf).select("goid", labels.above_threshold(value, 0.2).alias("selected"))


@query("sentiment_labels", f"""WITH {ARTICLES} SELECT goid, CASE WHEN bert_sentiment > 0.5 THEN 'positive'
 WHEN bert_sentiment < -0.5 THEN 'negative' ELSE 'neutral' END AS label FROM articles""")
def sentiment_labels(spark, sf):
    return articles(spark, sf).select("goid", labels.sentiment_label(F.col("bert_sentiment")).alias("label"))


@query("article_sizes", f"""WITH {ARTICLES} SELECT goid, CASE WHEN word_count < 300 THEN 'small' WHEN word_count > 1000 THEN 'large'
 ELSE 'medium' END AS article_size FROM articles""")
def article_sizes(spark, sf):
    return articles(spark, sf).select("goid", labels.size_class(F.col("word_count")).alias("article_size"))


@query("section_labels", f"""WITH s AS (SELECT d.doc_id AS goid, d.text, CASE WHEN d.doc_id % 13 = 0 THEN 'Finance/Business'
 WHEN d.doc_id % 13 = 1 THEN 'Metro' WHEN quality = 1 THEN 'Money' ELSE 'Arts' END AS section
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
 c AS (SELECT goid, {clean_sql('text')} AS processed, {clean_sql('section')} AS section FROM s)
 SELECT goid, CAST(CASE WHEN section IN ('money', 'finance business') THEN 1 ELSE 0 END AS INT) AS label, length(processed) AS length
 FROM c WHERE section IN ('money', 'finance business', 'arts') AND length(processed) >= 40""")
def section_labels(spark, sf):
    rows = clean.labelled_sections(sections(spark, sf))
    return rows.select("goid", "label", F.length("processed_text").cast("long").alias("length"))


def sections(spark, sf):
    """Labelled documents as articles with a newspaper section."""
    section = F.expr("""CASE WHEN doc_id % 13 = 0 THEN 'Finance/Business' WHEN doc_id % 13 = 1 THEN 'Metro'
        WHEN quality = 1 THEN 'Money' ELSE 'Arts' END""")
    return documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("goid"), "text", section.alias("section"))


@query("valid_pages", f"""WITH {ARTICLES} SELECT goid, page FROM articles WHERE page IS NOT NULL
 AND lower(page) NOT IN ('asnap', 'nan') AND len(string_split(page, '.')) <= 2""")
def valid_pages(spark, sf):
    return articles(spark, sf).select("goid", "page").filter(pages.valid_page(F.col("page")))


_ALL_TAGS = sorted({t.lower() for t in (*ECONOMIC_TAGS_INDEXED, *ECONOMIC_TAGS_OBSERVED)})


@query("tag_semi_join", f"WITH {ARTICLES} SELECT goid, tag FROM articles WHERE tag IN ({quoted(_ALL_TAGS)})")
def tag_semi_join(spark, sf):
    return _tagged(spark, sf)


def _tagged(spark, sf, **options):
    rows = articles(spark, sf).select("goid", F.col("tag").alias("topic"))
    return clean.with_tags(rows, clean.economic_tags(spark), "topic", **options).withColumnRenamed("topic", "tag")


@query("tag_semi_join_any_case", f"WITH {ARTICLES} SELECT goid, tag FROM articles WHERE lower(tag) IN ({quoted(_ALL_TAGS)})")
def tag_semi_join_any_case(spark, sf):
    return _tagged(spark, sf, case_insensitive=True)


@query("tag_anti_join", f"WITH {ARTICLES} SELECT goid, tag FROM articles WHERE tag NOT IN ({quoted(_ALL_TAGS)})")
def tag_anti_join(spark, sf):
    return _tagged(spark, sf, keep=False)


@query("tag_list_hits", f"""WITH {ARTICLES} SELECT lower(tag) AS tag, count(*) AS articles FROM articles
 WHERE lower(tag) IN ({quoted(_ALL_TAGS)}) GROUP BY 1""")
def tag_list_hits(spark, sf):
    rows = articles(spark, sf).select(F.lower("tag").alias("tag"))
    counts = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("articles"))
    return counts.join(F.broadcast(clean.economic_tags(spark)), "tag")


@query("derived_dates", f"""WITH {ARTICLES} SELECT goid, CAST(year(date) AS INT) AS year,
 concat(year(date), 'Q', quarter(date)) AS quarter FROM articles""")
def derived_dates(spark, sf):
    return articles(spark, sf).select("goid", F.year("date").alias("year"), labels.quarter_label(F.col("date")).alias("quarter"))


@query("weekday_names", f"""WITH {ARTICLES}, t AS (SELECT goid, CASE WHEN goid % 7 = 0 THEN strftime(date, '%d/%m/%Y')
 ELSE CAST(date AS VARCHAR) END AS text FROM articles)
 SELECT goid, CASE WHEN regexp_matches(text, '^[0-9-]+$') THEN dayname(CAST(CASE WHEN regexp_matches(text, '^[0-9-]+$') THEN text END AS DATE)) END AS weekday FROM t""")
def weekday_names(spark, sf):
    shown = F.when(F.col("goid") % 7 == 0, F.date_format("date", "dd/MM/yyyy")).otherwise(F.col("date").cast("string"))
    return articles(spark, sf).select("goid", labels.weekday_name(shown).alias("weekday"))


@query("column_subset", f"WITH {ARTICLES} SELECT goid AS article, word_count AS words, date FROM articles")
def column_subset(spark, sf):
    rows = articles(spark, sf).select("goid", "word_count", "date", "page")
    return rows.withColumnRenamed("goid", "article").withColumnRenamed("word_count", "words").drop("page")


# --- keys and sets ---------------------------------------------------------------------------

_DUPLICATED = "d AS (SELECT CAST(o_custkey AS BIGINT) AS goid, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice FROM orders)"


@query("dedup_key", f"""WITH {_DUPLICATED} SELECT goid, date, o_orderkey, o_totalprice FROM (SELECT *,
 row_number() OVER (PARTITION BY goid ORDER BY date, o_orderkey) AS rn FROM d) WHERE rn = 1""")
def dedup_key(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("goid"), F.col("o_orderdate").cast("date").alias("date"), "o_orderkey", "o_totalprice")
    return clean.distinct_by_key(rows, "goid", ["date", "o_orderkey"])


@query("dedup_text_md5", f"""WITH {ARTICLES} SELECT goid, date, word_count FROM (SELECT *,
 row_number() OVER (PARTITION BY md5(text) ORDER BY date, goid) AS rn FROM articles) WHERE rn = 1""")
def dedup_text_md5(spark, sf):
    rows = articles(spark, sf).select("goid", "date", "word_count", "text")
    return clean.distinct_by_text(rows, F.col("text")).select("goid", "date", F.col("word_count").cast("long").alias("word_count"))


@query("dedup_text_written", f"""WITH {ARTICLES} SELECT goid, date, text, md5(text) AS text_hash FROM (SELECT *,
 row_number() OVER (PARTITION BY md5(text) ORDER BY date, goid) AS rn FROM articles WHERE text IS NOT NULL) WHERE rn = 1""")
def dedup_text_written(spark, sf):
    """The de-duplicated table with its texts, written and read back."""
    path = shared_path(spark, "with-text")
    tables.write_distinct(articles(spark, sf).select("goid", "date", "text").filter("text IS NOT NULL"), path)
    return tables.read_csv_folder(spark, path, "goid bigint, date date, text string, text_hash string")


@query("manifest_pending", """SELECT concat(w.doc_id, '.xml') AS name FROM documents w WHERE doc_id % 3 <> 0 AND NOT EXISTS (
 SELECT 1 FROM labels d WHERE d.doc_id = w.doc_id)""")
def manifest_pending(spark, sf):
    wanted = names(spark, sf).filter("doc_id % 3 <> 0").select("name")
    done = table(spark, sf, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".xml")).alias("name"))
    return clean.pending(wanted, done)


@query("manifest_semi_join", f"WITH {ARTICLES} SELECT goid, date FROM articles WHERE goid IN (SELECT doc_id FROM labels)")
def manifest_semi_join(spark, sf):
    rows = articles(spark, sf).select("goid", "date")
    return clean.listed(rows, table(spark, sf, "labels").select(F.col("doc_id").alias("goid")), "goid")


@query("page_size_lookup", f"""WITH {ARTICLES}, s(publisher, page_size) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in PAGE_SIZES.items())})
 SELECT goid, CAST(page_size AS INT) AS page_size FROM (SELECT goid, {alias_sql('publisher')} AS publisher FROM articles) a
 LEFT JOIN s ON a.publisher = s.publisher""")
def page_size_lookup(spark, sf):
    rows = clean.fold_publishers(articles(spark, sf).select("goid", "publisher"))
    return rows.select("goid", sal.page_size(F.col("publisher")).alias("page_size"))


@query("alias_table_join", f"""WITH {ARTICLES} SELECT publisher, count(*) AS articles
 FROM (SELECT {alias_sql('publisher')} AS publisher FROM articles) GROUP BY 1""")
def alias_table_join(spark, sf):
    rows = articles(spark, sf).select(F.lower("publisher").alias("src"))
    joined = rows.join(F.broadcast(tables.publisher_aliases(spark)), "src", "left")
    return joined.groupBy(F.coalesce("dst", "src").alias("publisher")).agg(F.count(F.lit(1)).alias("articles"))


@query("union_all_columns", """SELECT doc_id, lang, NULL AS quality FROM documents
 UNION ALL SELECT doc_id, NULL, quality FROM labels""")
def union_all_columns(spark, sf):
    return clean.union_all([documents(spark, sf).select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality")])


@query("union_with_empty", "SELECT doc_id, quality FROM labels")
def union_with_empty(spark, sf):
    present = table(spark, sf, "labels").select("doc_id", "quality")
    absent = tables.read_csv_folder(spark, f"{sf}/no-such-folder", present.schema)
    return clean.union_all([absent, present])


@query("union_distinct", "SELECT lower(lang) AS value FROM documents UNION SELECT lower(event_type) FROM events")
def union_distinct(spark, sf):
    tags = documents(spark, sf).select(F.lower("lang").alias("value"))
    return tags.union(table(spark, sf, "events").select(F.lower("event_type"))).distinct()


@query("difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(spark, sf):
    return documents(spark, sf).select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id"))


@query("distinct_values", f"WITH {ARTICLES} SELECT DISTINCT publisher FROM articles")
def distinct_values(spark, sf):
    return articles(spark, sf).select("publisher").distinct()


@query("preview_slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 2")
def preview_slice(spark, sf):
    """A preview: the limit is the feature."""
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(2).limit(5)


@query("row_count_and_first", f"""WITH {ARTICLES} SELECT count(*) AS rows, min_by(publisher, goid) AS first_publisher FROM articles""")
def row_count_and_first(spark, sf):
    return articles(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.min_by("publisher", "goid").alias("first_publisher"))


@query("sample_articles", """SELECT name FROM (SELECT concat(doc_id, '.xml') AS name FROM documents)
 ORDER BY md5(concat(name, '#7')), name LIMIT 300""")
def sample_articles(spark, sf):
    """A sample without replacement: the size is the feature."""
    return scale.sample_rows(names(spark, sf).select("name"), "name", 300, seed=7)


@query("chunk_number", """WITH l AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE concat(' ', doc_id, '.xml') END AS line FROM documents),
 r AS (SELECT trim(line) AS name, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS chunk FROM l)
 SELECT name, CAST(chunk AS BIGINT) AS chunk FROM r WHERE name <> ''""")
def chunk_number(spark, sf):
    lines = names(spark, sf).select("doc_id", F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "name")).alias("name"))
    return tables.numbered_chunks(lines, 64, ["doc_id"]).select("name", "chunk")


@query("chunk_listing", """SELECT DISTINCT concat('chunk_', l_suppkey % 37, '_data.csv') AS name, CAST(l_suppkey % 37 AS INT) AS number FROM lineitem""")
def chunk_listing(spark, sf):
    files = table(spark, sf, "lineitem").select(F.concat(F.lit("chunk_"), (F.col("l_suppkey") % 37).cast("string"), F.lit("_data.csv")).alias("name")).distinct()
    return files.select("name", tables.chunk_number(F.col("name")).alias("number")).orderBy("number")
