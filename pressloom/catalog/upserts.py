"""Tag edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upsert
from .base import ARTICLES, articles, query

# Old values are null for every sixth article and zero for every other ninth; updates hit every fourth.
BASE = f"""{ARTICLES}, base AS (SELECT goid, CASE WHEN goid % 6 = 0 THEN NULL WHEN goid % 9 = 0 THEN 0.0E0 ELSE bert_sentiment END AS old FROM articles),
 updates AS (SELECT goid, CASE WHEN goid % 8 = 0 THEN NULL ELSE goid / 7.0E0 END AS new FROM articles WHERE goid % 4 = 0)"""


def base(spark, sf):
    old = F.when(F.col("goid") % 6 == 0, None).when(F.col("goid") % 9 == 0, 0.0).otherwise(F.col("bert_sentiment"))
    return articles(spark, sf).select("goid", old.alias("old"))


def updates(spark, sf):
    rows = articles(spark, sf).filter("goid % 4 = 0")
    return rows.select("goid", F.expr("CASE WHEN goid % 8 = 0 THEN NULL ELSE goid / 7.0E0 END").alias("new"))


def _sql(value: str) -> str:
    return f"WITH {BASE} SELECT b.goid, round({value}, 6) AS old FROM base b LEFT JOIN updates u ON b.goid = u.goid"


def _rounded(df):
    return df.withColumn("old", F.round("old", 6))


@query("upsert_overwrite", _sql("coalesce(new, old)"))
def upsert_overwrite(spark, sf):
    return _rounded(upsert.set_columns(base(spark, sf), updates(spark, sf), {"new": "old"}, modify=True))


@query("upsert_keep", _sql("coalesce(old, new)"))
def upsert_keep(spark, sf):
    return _rounded(upsert.set_columns(base(spark, sf), updates(spark, sf), {"new": "old"}, modify=False))


@query("upsert_new_column", f"WITH {BASE} SELECT b.goid, round(new, 6) AS added FROM base b LEFT JOIN updates u ON b.goid = u.goid")
def upsert_new_column(spark, sf):
    out = upsert.set_columns(base(spark, sf), updates(spark, sf), {"new": "added"})
    return out.select("goid", F.round("added", 6).alias("added"))


@query("delete_tag", f"WITH {ARTICLES} SELECT goid, concat('lang=', lang, ';tag=', tag) AS tags FROM articles")
def delete_tag(spark, sf):
    tags = F.create_map(F.lit("lang"), F.col("lang"), F.lit("grades"), F.lit("x"), F.lit("tag"), F.col("tag"))
    left = upsert.delete_tag(tags, "grades")
    shown = F.array_join(F.transform(F.map_entries(left), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return articles(spark, sf).select("goid", shown.alias("tags"))


_NAMES = "goid % 3 <> 0 AND goid % 5 <> 0"


@query("csv_to_record_merge", f"""WITH {BASE} SELECT b.goid, round(CASE WHEN u.goid IS NOT NULL AND b.{_NAMES.replace('AND goid', 'AND b.goid')}
 THEN coalesce(round(new, 4), old) ELSE old END, 6) AS old FROM base b LEFT JOIN updates u ON b.goid = u.goid""")
def csv_to_record_merge(spark, sf):
    return _rounded(_merged(spark, sf)[0].withColumn("goid", F.col("goid").cast("long")))


@query("csv_to_record_names", f"WITH {BASE} SELECT concat(goid, '.xml') AS name FROM updates WHERE {_NAMES}")
def csv_to_record_names(spark, sf):
    return _merged(spark, sf)[1]


def _merged(spark, sf):
    pending = articles(spark, sf).filter(_NAMES).select(F.concat(F.col("goid").cast("string"), F.lit(".xml")).alias("name"))
    records = base(spark, sf).withColumn("goid", F.col("goid").cast("string"))
    return upsert.table_to_records(records, updates(spark, sf), {"new": "old"}, pending)


@query("record_to_csv_merge", f"""WITH {BASE} SELECT b.goid, round(CASE WHEN u.goid IS NOT NULL THEN new ELSE old END, 6) AS old
 FROM base b LEFT JOIN updates u ON b.goid = u.goid""")
def record_to_csv_merge(spark, sf):
    records = updates(spark, sf).select(F.col("goid").cast("string").alias("goid"), F.col("new").alias("old"))
    return _rounded(upsert.records_to_table(base(spark, sf), records, ["old"]))


@query("rescore_missing", f"WITH {BASE} SELECT goid, round(CASE WHEN old IS NULL OR old = 0 THEN goid / 3.0E0 ELSE old END, 6) AS old FROM base")
def rescore_missing(spark, sf):
    return _rounded(upsert.rescore_missing(base(spark, sf), "old", F.expr("goid / 3.0E0")))
