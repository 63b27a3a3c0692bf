"""Salience, trends and page statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, salience as sal
from ..operators import clean, pages, trends
from ..plans import steps
from ..schema import ONLINE_ALIASES, PAGE_SIZES
from ..sources import tables
from .base import ARTICLES, articles, query, table
from .cleaning import alias_sql


def _scores(a: str, b: str, c: str, d: str) -> str:
    return f"CASE num WHEN 1 THEN {a} WHEN 2 THEN {b} WHEN 3 THEN {c} ELSE {d} END"


PARTS = r"""CASE WHEN trim(p) = '.' THEN NULL
 WHEN regexp_matches(p, '^([0-9]{1,2}|\p{L})$') THEN [ltrim(p, '0')]
 WHEN regexp_matches(p, '^[^.]{2}$') THEN list_sort([p[1], p[2]])
 WHEN regexp_matches(p, '^\p{L}[0-9]{2}$') THEN [p[2:3], p[1]]
 WHEN regexp_matches(p, '^[^.]*[.][^.]*$') THEN list_sort(list_transform(string_split(p, '.'),
   lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN ltrim(x, '0') ELSE x END))
 WHEN regexp_matches(p, '^[0-9]+[.]part[.]') THEN [ltrim(string_split(p, '.')[1], '0')] END"""
PAGE_SCORE = f"""CASE WHEN parts IS NULL OR (num IS NULL AND len(parts) = 2) THEN NULL
 WHEN let = 'a' THEN {_scores('1.0E0', '0.9E0', '0.8E0', '0.7E0')}
 WHEN let IN ('b', 'c') THEN {_scores('0.9E0', '0.8E0', '0.7E0', '0.6E0')}
 WHEN num IS NULL THEN NULL ELSE {_scores('0.8E0', '0.7E0', '0.6E0', '0.5E0')} END"""
SIZE = "CASE publisher " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PAGE_SIZES.items()) + " END"


def scored(source: str) -> str:
    """CTEs that add page parts and salience to ``source``, whose publishers are folded."""
    return f"""parted AS (SELECT *, {PARTS} AS parts FROM (SELECT *, lower(page) AS p FROM {source})),
 numbered AS (SELECT *, TRY_CAST(parts[1] AS BIGINT) AS num, parts[len(parts)] AS let FROM parted),
 sized AS (SELECT *, {PAGE_SCORE} AS page_score, {SIZE} AS page_size,
  CASE dayofweek(date) WHEN 0 THEN 1.0E0 WHEN 6 THEN 0.9E0 ELSE 0.8E0 END AS day_score FROM numbered),
 scored AS (SELECT *, round(day_score * page_score * (2.0E0 * least(word_count * 1.0E0 / page_size, 1.0E0)
   - least(word_count * 1.0E0 / page_size, 1.0E0) * least(word_count * 1.0E0 / page_size, 1.0E0)), 3) AS salience_score
  FROM sized WHERE page_size IS NOT NULL)"""


FOLDED = f"folded AS (SELECT * REPLACE ({alias_sql('publisher')} AS publisher) FROM articles)"
ANALYSED = f"""{ARTICLES}, {FOLDED}, kept AS (SELECT * FROM folded WHERE publisher <> 'new york times español'
 AND bert_sentiment IS NOT NULL AND page IS NOT NULL AND year(date) > 2003 AND year(date) < 2024),
 {scored('kept')}, analysed AS (SELECT *, bert_sentiment * salience_score AS adjusted_sentiment,
 concat(year(date), 'Q', quarter(date)) AS quarter, CAST(year(date) AS INT) AS year FROM scored WHERE salience_score IS NOT NULL)"""
DESCRIBED = f"""{ARTICLES}, {FOLDED}, described AS (SELECT *, CAST(year(date) AS INT) AS year FROM (SELECT *,
 row_number() OVER (PARTITION BY md5(text) ORDER BY date, goid) AS rn FROM folded WHERE publisher <> 'new york times español'
 AND page IS NOT NULL AND year(date) > 2003 AND year(date) < 2024) WHERE rn = 1)"""


def year():
    return F.year("date").alias("year")


def quarter():
    return labels.quarter_label(F.col("date")).alias("quarter")


def publisher():
    return F.col("publisher")


def flag():
    return F.when(F.col("is_economic") > 0.5, 1).otherwise(0)


def analysed(spark, sf):
    return steps.analysed(articles(spark, sf).drop("text", "section", "tag", "lang"))


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("page_normalized", f"""WITH {ARTICLES}, parted AS (SELECT goid, {PARTS} AS parts FROM (SELECT goid, lower(page) AS p FROM articles)),
 numbered AS (SELECT *, TRY_CAST(parts[1] AS BIGINT) AS num, parts[len(parts)] AS let FROM parted)
 SELECT goid, nullif(array_to_string(parts, '.'), '') AS page, {PAGE_SCORE} AS score FROM numbered""")
def page_normalized(spark, sf):
    page = sal.normalize_page(F.col("page"))
    rows = articles(spark, sf).select("goid", page.alias("page"))
    return rows.withColumn("score", sal.page_score(F.col("page")))


@query("day_scores", f"""WITH {ARTICLES} SELECT goid, CASE dayofweek(date) WHEN 0 THEN 1.0E0 WHEN 6 THEN 0.9E0 ELSE 0.8E0 END AS day_score
 FROM articles""")
def day_scores(spark, sf):
    return articles(spark, sf).select("goid", sal.day_score(F.col("date")).alias("day_score"))


@query("salience_score", f"WITH {ARTICLES}, {FOLDED}, {scored('folded')} SELECT goid, salience_score FROM scored WHERE salience_score IS NOT NULL")
def salience_score(spark, sf):
    rows = trends.with_salience(clean.fold_publishers(articles(spark, sf)))
    return rows.select("goid", "salience_score").filter(F.col("salience_score").isNotNull())


@query("adjusted_sentiment", f"WITH {ANALYSED} SELECT goid, publisher, date, salience_score, round(adjusted_sentiment, 6) AS adjusted_sentiment FROM analysed")
def adjusted_sentiment(spark, sf):
    return rounded(analysed(spark, sf), "adjusted_sentiment").select("goid", "publisher", "date", "salience_score", "adjusted_sentiment")


_Z = "SELECT avg(bert_sentiment) AS m1, stddev_samp(bert_sentiment) AS s1, avg(adjusted_sentiment) AS m2, stddev_samp(adjusted_sentiment) AS s2 FROM analysed"


@query("sentiment_zscore", f"""WITH {ANALYSED}, z AS ({_Z}) SELECT goid,
 round((bert_sentiment - (SELECT m1 FROM z)) / (SELECT s1 FROM z), 6) AS normalized_sentiment,
 round((adjusted_sentiment - (SELECT m2 FROM z)) / (SELECT s2 FROM z), 6) AS normalized_adjusted_sentiment FROM analysed""")
def sentiment_zscore(spark, sf):
    rows = trends.zscore(analysed(spark, sf), {
        "bert_sentiment": "normalized_sentiment", "adjusted_sentiment": "normalized_adjusted_sentiment"})
    return rounded(rows, "normalized_sentiment", "normalized_adjusted_sentiment").select(
        "goid", "normalized_sentiment", "normalized_adjusted_sentiment")


@query("salience_quarterly", f"""WITH {ANALYSED}, z AS ({_Z}) SELECT quarter,
 round(avg((bert_sentiment - (SELECT m1 FROM z)) / (SELECT s1 FROM z)), 6) AS normalized_sentiment,
 round(avg((adjusted_sentiment - (SELECT m2 FROM z)) / (SELECT s2 FROM z)), 6) AS normalized_adjusted_sentiment
 FROM analysed GROUP BY quarter""")
def salience_quarterly(spark, sf):
    return rounded(steps.quarterly_sentiment(articles(spark, sf).drop("text", "section", "tag", "lang")),
                   "normalized_sentiment", "normalized_adjusted_sentiment")


@query("sentiment_zscore_quarter", """SELECT concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS quarter, o_orderpriority AS publisher,
 round(avg((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders)), 6) AS z
 FROM orders GROUP BY 1, 2""")
def sentiment_zscore_quarter(spark, sf):
    rows = table(spark, sf, "orders").select(
        labels.quarter_label(F.col("o_orderdate")).alias("quarter"), F.col("o_orderpriority").alias("publisher"), "o_totalprice")
    return rounded(trends.mean_zscore(rows, {"o_totalprice": "z"}, [F.col("quarter"), F.col("publisher")]), "z")


@query("sentiment_quarter_publisher", f"""WITH {ANALYSED} SELECT quarter, publisher, round(avg(adjusted_sentiment), 10) AS adjusted_sentiment,
 round(avg(bert_sentiment), 10) AS bert_sentiment FROM analysed GROUP BY 1, 2""")
def sentiment_quarter_publisher(spark, sf):
    means = trends.means_by(analysed(spark, sf), [quarter(), publisher()], ["adjusted_sentiment", "bert_sentiment"])
    return rounded(means, "adjusted_sentiment", "bert_sentiment", digits=10)


@query("sentiment_quarter_one_publisher", f"""WITH {ANALYSED} SELECT quarter, publisher, round(avg(adjusted_sentiment), 10) AS adjusted_sentiment,
 round(avg(bert_sentiment), 10) AS bert_sentiment FROM analysed WHERE publisher = 'usa today' GROUP BY 1, 2""")
def sentiment_quarter_one_publisher(spark, sf):
    rows = analysed(spark, sf).filter(publisher() == "usa today")
    return rounded(trends.means_by(rows, [quarter(), publisher()], ["adjusted_sentiment", "bert_sentiment"]), "adjusted_sentiment", "bert_sentiment", digits=10)


@query("sentiment_quarter_all", f"""WITH {ARTICLES} SELECT concat(year(date), 'Q', quarter(date)) AS quarter,
 round(avg(bert_sentiment), 10) AS bert_sentiment FROM articles WHERE year(date) > 1989 GROUP BY 1""")
def sentiment_quarter_all(spark, sf):
    rows = clean.years(articles(spark, sf), after=1989)
    return rounded(trends.means_by(rows, [quarter()], ["bert_sentiment"]), "bert_sentiment", digits=10)


@query("sentiment_year_publisher", f"""WITH {ANALYSED} SELECT year, publisher, round(avg(adjusted_sentiment), 10) AS adjusted_sentiment,
 round(avg(bert_sentiment), 10) AS bert_sentiment FROM analysed GROUP BY 1, 2""")
def sentiment_year_publisher(spark, sf):
    means = trends.means_by(analysed(spark, sf), [year(), publisher()], ["adjusted_sentiment", "bert_sentiment"])
    return rounded(means, "adjusted_sentiment", "bert_sentiment", digits=10)


@query("sentiment_year", f"""WITH {ARTICLES} SELECT CAST(year(date) AS INT) AS year, round(avg(bert_sentiment), 10) AS bert_sentiment
 FROM articles WHERE year(date) > 1989 GROUP BY 1""")
def sentiment_year(spark, sf):
    return rounded(trends.means_by(clean.years(articles(spark, sf), after=1989), [year()], ["bert_sentiment"]), "bert_sentiment", digits=10)


def _label(c: str) -> str:
    return f"CASE WHEN {c} > 0.5 THEN 'positive' WHEN {c} < -0.5 THEN 'negative' ELSE 'neutral' END"


LABELS = f"""{ANALYSED},
 a AS (SELECT publisher, year, {_label('adjusted_sentiment')} AS label, count(*) AS count_adjusted FROM analysed GROUP BY ALL),
 b AS (SELECT publisher, year, {_label('bert_sentiment')} AS label, count(*) AS count_bert FROM analysed GROUP BY ALL),
 wide AS (SELECT * FROM a FULL OUTER JOIN b USING (publisher, year, label))"""
_SCORES = {"adjusted_sentiment": "count_adjusted", "bert_sentiment": "count_bert"}


@query("label_counts_one_pass", f"WITH {LABELS} SELECT publisher, year, label, count_adjusted, count_bert FROM wide")
def label_counts_one_pass(spark, sf):
    return trends.label_counts(analysed(spark, sf), _SCORES, [publisher(), year()])


@query("label_counts_outer", f"WITH {LABELS} SELECT publisher, year, label, count_adjusted, count_bert FROM wide")
def label_counts_outer(spark, sf):
    rows = analysed(spark, sf)
    sides = [
        trends.counts_by(rows, [publisher(), year(), labels.sentiment_label(F.col(c)).alias("label")], name)
        for c, name in _SCORES.items()
    ]
    return sides[0].join(sides[1], ["publisher", "year", "label"], "outer")


@query("label_counts_long", f"""WITH {LABELS} SELECT publisher, year, label, 'count_adjusted' AS count_type, count_adjusted AS count FROM wide
 UNION ALL SELECT publisher, year, label, 'count_bert', count_bert FROM wide""")
def label_counts_long(spark, sf):
    return trends.long_counts(label_counts_one_pass(spark, sf), ["publisher", "year", "label"], ["count_adjusted", "count_bert"])


@query("label_counts_year", f"""WITH {ARTICLES} SELECT CAST(year(date) AS INT) AS year, {_label('bert_sentiment')} AS label, count(*) AS count
 FROM articles WHERE year(date) > 1989 GROUP BY 1, 2""")
def label_counts_year(spark, sf):
    rows = clean.years(articles(spark, sf), after=1989)
    return trends.counts_by(rows, [year(), labels.sentiment_label(F.col("bert_sentiment")).alias("label")])


@query("articles_per_year", f"WITH {DESCRIBED} SELECT year, count(*) AS count FROM described GROUP BY 1")
def articles_per_year(spark, sf):
    return trends.counts_by(steps.described(articles(spark, sf)), [year()])


@query("articles_per_year_publisher", f"WITH {DESCRIBED} SELECT year, publisher, count(*) AS count FROM described GROUP BY 1, 2")
def articles_per_year_publisher(spark, sf):
    return trends.counts_by(steps.described(articles(spark, sf)), [year(), publisher()])


@query("articles_per_size", f"""WITH {DESCRIBED} SELECT year, CASE WHEN word_count < 300 THEN 'small' WHEN word_count > 1000 THEN 'large'
 ELSE 'medium' END AS article_size, count(*) AS count FROM described GROUP BY 1, 2""")
def articles_per_size(spark, sf):
    return trends.counts_by(steps.described(articles(spark, sf)), [year(), labels.size_class(F.col("word_count")).alias("article_size")])


@query("articles_per_flag", f"""WITH {DESCRIBED} SELECT year, CAST(CASE WHEN is_economic > 0.5 THEN 1 ELSE 0 END AS INT) AS is_economic,
 count(*) AS count FROM described GROUP BY 1, 2""")
def articles_per_flag(spark, sf):
    return trends.counts_by(steps.described(articles(spark, sf)), [year(), flag().alias("is_economic")])


_RATIO = """CASE WHEN count(*) FILTER (is_economic > 0.5) > 0 AND count(*) FILTER (is_economic <= 0.5) > 0
 THEN round(count(*) FILTER (is_economic > 0.5) * 1.0E0 / count(*), 6) END AS ratio"""


@query("economic_ratio_year", f"WITH {DESCRIBED} SELECT year, {_RATIO} FROM described GROUP BY 1")
def economic_ratio_year(spark, sf):
    rows = steps.described(articles(spark, sf)).withColumn("flag", flag())
    return rounded(trends.share_of_ones(rows, "flag", [year()]), "ratio")


@query("economic_ratio_year_publisher", f"WITH {DESCRIBED} SELECT year, publisher, {_RATIO} FROM described GROUP BY 1, 2")
def economic_ratio_year_publisher(spark, sf):
    rows = steps.described(articles(spark, sf)).withColumn("flag", flag())
    return rounded(trends.share_of_ones(rows, "flag", [year(), publisher()]), "ratio")


@query("wordcount_thresholds", f"""WITH {ARTICLES} SELECT publisher, CAST(year(date) AS INT) AS year, count(*) FILTER (word_count > 0) AS above_0,
 count(*) FILTER (word_count > 300) AS above_300, count(*) FILTER (word_count > 1000) AS above_1000 FROM articles GROUP BY 1, 2""")
def wordcount_thresholds(spark, sf):
    return trends.counts_above(articles(spark, sf), "word_count", [0, 300, 1000], [publisher(), year()])


# --- pages -----------------------------------------------------------------------------------

PAGES = f"""{ARTICLES}, paged AS (SELECT goid, date, publisher, word_count, nullif(array_to_string({PARTS}, '.'), '') AS page FROM (
 SELECT goid, date, {alias_sql('publisher', ONLINE_ALIASES)} AS publisher, word_count, lower(page) AS p FROM articles WHERE page IS NOT NULL
 AND lower(page) NOT IN ('asnap', 'nan') AND len(string_split(page, '.')) <= 2)),
 daily AS (SELECT date, page, CAST(sum(word_count) AS BIGINT) AS words, count(word_count) AS articles FROM paged WHERE page IS NOT NULL GROUP BY 1, 2),
 means AS (SELECT page, sum(words * articles) * 1.0E0 / sum(articles) AS mean_words FROM daily GROUP BY 1),
 counts AS (SELECT page, count(*) AS count FROM paged WHERE page IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
 stats AS (SELECT page, mean_words, count FROM means JOIN counts USING (page))"""


def paged(spark, sf):
    return pages.normalized_pages(clean.fold_publishers(articles(spark, sf), aliases=ONLINE_ALIASES))


@query("page_words", f"WITH {PAGES} SELECT * FROM daily")
def page_words(spark, sf):
    return pages.page_words(paged(spark, sf))


@query("page_weighted_mean", f"WITH {PAGES} SELECT page, round(mean_words, 6) AS mean_words FROM means")
def page_weighted_mean(spark, sf):
    return rounded(pages.weighted_words(pages.page_words(paged(spark, sf))), "mean_words")


@query("page_counts", f"WITH {PAGES} SELECT * FROM counts")
def page_counts(spark, sf):
    return pages.page_counts(paged(spark, sf))


@query("page_stats", f"WITH {PAGES} SELECT page, round(mean_words, 6) AS mean_words, count FROM stats ORDER BY mean_words DESC")
def page_stats(spark, sf):
    return rounded(pages.page_stats(paged(spark, sf)), "mean_words").orderBy(F.desc("mean_words"), "page")


@query("page_size_json", f"WITH {PAGES} SELECT page, round(mean_words, 6) AS mean_words, count FROM stats")
def page_size_json(spark, sf):
    lines = tables.page_size_json(pages.page_stats(paged(spark, sf)))
    return rounded(lines.select(F.from_json("value", "page string, mean_words double, count bigint").alias("v")).select("v.*"), "mean_words")


@query("page_size_plan", f"""WITH {PAGES.replace('FROM articles WHERE page IS NOT NULL', "FROM articles WHERE page IS NOT NULL AND publisher <> 'New York Times Español'")}
 SELECT page, round(mean_words, 6) AS mean_words, count FROM stats""")
def page_size_plan(spark, sf):
    """Every fifth article once more, a year later and on another page: the earliest copy counts."""
    rows = articles(spark, sf).select("goid", "date", "page", "publisher", "word_count")
    again = rows.filter("goid % 5 = 0").withColumn("date", F.date_add("date", 365)).withColumn("page", F.lit("Z.9"))
    return rounded(steps.page_sizes(rows.unionByName(again)), "mean_words")


@query("publisher_page_size", f"""WITH {PAGES} SELECT round(sum(mean_words * count) / sum(count), 6) AS weighted_mean,
 round(median(mean_words), 6) AS median, round(avg(mean_words), 6) AS plain_mean FROM stats""")
def publisher_page_size(spark, sf):
    return rounded(pages.publisher_page_size(pages.page_stats(paged(spark, sf))), "weighted_mean", "median", "plain_mean")


@query("page_value_counts", f"WITH {ARTICLES} SELECT page, count(*) AS count FROM articles WHERE page IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def page_value_counts(spark, sf):
    """A top-ten report: the limit is the feature."""
    return pages.value_counts(articles(spark, sf), "page").orderBy(F.desc("count"), "page").limit(10)


@query("page_unique_values", f"WITH {ARTICLES} SELECT count(DISTINCT page) AS pages FROM articles")
def page_unique_values(spark, sf):
    return pages.value_counts(articles(spark, sf), "page").agg(F.count(F.lit(1)).alias("pages"))


@query("tag_frequency", f"WITH {ARTICLES} SELECT tag, count(*) AS count FROM articles GROUP BY 1 HAVING count(*) >= 20")
def tag_frequency(spark, sf):
    return pages.value_counts(articles(spark, sf), "tag", 20)


@query("tag_lines", """WITH t AS (SELECT l_suppkey AS tag, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 20),
 r AS (SELECT concat('tag ', tag) AS tag, row_number() OVER (ORDER BY n DESC, concat('tag ', tag)) AS rn FROM t)
 SELECT CAST((rn - 1) // 6 AS BIGINT) AS line, string_agg(tag, ', ' ORDER BY rn) AS value FROM r GROUP BY 1""")
def tag_lines(spark, sf):
    tags = table(spark, sf, "lineitem").select(F.concat(F.lit("tag "), F.col("l_suppkey").cast("string")).alias("tag"))
    return tables.tag_lines(pages.value_counts(tags, "tag", 20))


@query("article_paths", f"""WITH {ARTICLES} SELECT concat(lower(replace(publisher, ' ', '')), '/', goid, '.xml') AS value FROM articles
 WHERE lower(tag) IN ('banks', 'budgets', 'inflation', 'prices')""")
def article_paths(spark, sf):
    rows = articles(spark, sf).select("goid", F.col("tag").alias("topic"), "publisher")
    economic = clean.with_tags(rows, clean.economic_tags(spark), "topic", case_insensitive=True)
    return tables.article_paths(economic, F.lower(F.replace("publisher", F.lit(" "), F.lit(""))))
