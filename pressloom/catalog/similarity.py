"""Near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neardup
from .base import documents, query

# DuckDB form of the signatures and buckets.
_MINIMA = ", ".join(f"min(({a} * h + {b}) % {neardup.PRIME}) AS m{i}" for i, (a, b) in enumerate(neardup.coefficients()))
SIGNED = rf"""tok AS (SELECT doc_id, CAST(concat('0x', substr(md5(t), 1, 7)) AS BIGINT) AS h FROM (
 SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\S+'))) AS t FROM documents)),
 signed AS (SELECT doc_id, {_MINIMA} FROM tok GROUP BY doc_id)"""
_ROWS = neardup.PERMUTATIONS // neardup.BANDS
_BUCKETS = ", ".join(
    f"md5(concat_ws('_', {k}, {', '.join(f'm{k * _ROWS + j}' for j in range(_ROWS))}))" for k in range(neardup.BANDS))
BANDED = f"{SIGNED}, banded AS (SELECT doc_id, unnest([{_BUCKETS}]) AS bucket FROM signed)"


@query("minhash_signature", f"WITH {SIGNED} SELECT doc_id, md5(concat_ws('_', {', '.join(f'm{i}' for i in range(neardup.PERMUTATIONS))})) AS signature FROM signed")
def minhash_signature(spark, sf):
    signed = neardup.signatures(documents(spark, sf))
    minima = [F.col(f"m{i}").cast("string") for i in range(neardup.PERMUTATIONS)]
    return signed.select("doc_id", F.md5(F.concat_ws("_", *minima)).alias("signature"))


@query("band_buckets", f"WITH {BANDED} SELECT doc_id, bucket FROM banded")
def band_buckets(spark, sf):
    return neardup.band_keys(neardup.signatures(documents(spark, sf)))


@query("neardup_first_in_bucket", f"""WITH {BANDED} SELECT doc_id FROM signed WHERE doc_id NOT IN (
 SELECT doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY bucket) AS first FROM banded) WHERE first < doc_id)""")
def neardup_first_in_bucket(spark, sf):
    return neardup.first_in_bucket(neardup.band_keys(neardup.signatures(documents(spark, sf))))


# The sequential rule, one document per recursion step.
SEQUENTIAL = f"""WITH RECURSIVE {BANDED}, docs AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i,
  list(CAST(concat('0x', substr(bucket, 1, 15)) AS BIGINT)) AS bs FROM banded GROUP BY doc_id),
 walk AS (SELECT i, doc_id, true AS kept, bs AS seen FROM docs WHERE i = 1
  UNION ALL SELECT d.i, d.doc_id, NOT list_has_any(w.seen, d.bs), CASE WHEN list_has_any(w.seen, d.bs) THEN w.seen ELSE list_concat(w.seen, d.bs) END
  FROM walk w JOIN docs d ON d.i = w.i + 1)
 SELECT doc_id FROM walk WHERE kept"""


@query("neardup_greedy", SEQUENTIAL)
def neardup_greedy(spark, sf):
    return neardup.greedy(neardup.band_keys(neardup.signatures(documents(spark, sf))))


@query("neardup_verified", rf"""WITH {BANDED}, f AS (SELECT DISTINCT doc_id, first AS other FROM (
 SELECT doc_id, min(doc_id) OVER (PARTITION BY bucket) AS first FROM banded) WHERE first < doc_id),
 s AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '\S+')) AS ts FROM documents),
 j AS (SELECT f.doc_id, f.other, len(list_intersect(a.ts, b.ts)) AS i, len(a.ts) + len(b.ts) AS n FROM f JOIN s a ON f.doc_id = a.doc_id JOIN s b ON f.other = b.doc_id)
 SELECT doc_id, other, round(i * 1.0E0 / (n - i), 6) AS jaccard FROM j WHERE i * 1.0E0 / (n - i) >= 0.99E0""")
def neardup_verified(spark, sf):
    docs = documents(spark, sf)
    links = neardup.bucket_links(neardup.band_keys(neardup.signatures(docs)))
    return neardup.verified(links, docs).select("doc_id", "other", F.round("jaccard", 6).alias("jaccard"))
