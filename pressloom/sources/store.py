"""A store of parsed articles, so that loads by manifest read what the manifest lists and nothing else.

Files are parsed once and kept as Parquet below ``corpus=<corpus>/bucket=<n>``, the bucket by a hash of the record's
name, rows in order of name. A load prunes to the corpora and buckets of its manifest before it joins, so a manifest of
one corpus reads that corpus, and one of a few names reads a few buckets. New files are added as runs that are committed
wholly or not at all; malformed and empty files are logged with their error and looked at again only if asked for.

A record's name is ``<goid>.xml``, whatever file holds it: a file may hold many records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.scale import lookup_join
from ..schema import ARTICLE_SCHEMA
from ..streaming import commits
from . import records

STEP = "store"
BUCKETS = 64
#: Listed (corpus, bucket) folders up to which a load prunes by bucket; corpora are always pruned.
LISTED = 4096


def _bucket(name: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")


def record_name(goid: Column) -> Column:
    return F.concat(goid, F.lit(".xml"))


def schema(tags: Sequence[str] = ()) -> T.StructType:
    """Columns of a store: corpus and name, the article columns, tags; buckets are folders."""
    text = T.StringType()
    kinds = {"tf_idf": T.ArrayType(text)}
    return T.StructType([T.StructField("name", text), *ARTICLE_SCHEMA.fields, *[T.StructField(t, kinds.get(t, text)) for t in tags],
                         T.StructField("corpus", text), T.StructField("bucket", T.IntegerType())])


def _records_of(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Records of listed files. Few files hold many records, so the list goes to the records while it is small."""
    listed = files.select(F.struct("corpus", "name").alias("_file")).distinct()
    return lookup_join(rows.withColumn("_file", F.struct("corpus", "name")), listed, "_file", how="left_semi").drop("_file")


def add(spark: SparkSession, folder: str, path: str, tags: Sequence[str] = (), glob: str = "*.xml", buckets: int = BUCKETS,
        retry_errors: bool = False) -> dict:
    """Parse the files of a folder that the store does not hold yet. Returns counts of files and of those with an error."""
    files = records.list_files(spark, folder, glob)
    done = commits.read_log(spark, path, STEP)
    if retry_errors:
        done = done.filter(F.col("status") == "ok")
    todo = files.join(done.select("corpus", "name"), ["corpus", "name"], "left_anti")
    run = commits.run_id(todo, path, STEP)
    if run is None:
        return {"files": 0, "errors": 0}
    parsed = _records_of(records.read_records(spark, folder, glob), todo)
    rows = records.articles(parsed, tags).withColumn("name", record_name(F.col("goid"))).filter(F.col("goid").isNotNull())
    placed = rows.withColumn("bucket", _bucket(F.col("name"), buckets)).select(*schema(tags).names)
    target = f"{path}/articles/run={run}"
    # a bucket of a corpus is one task's, so even a hot corpus is dealt out
    (placed.repartition("corpus", "bucket").sortWithinPartitions("corpus", "bucket", "name")
     .write.mode("overwrite").partitionBy("corpus", "bucket").parquet(target))
    broken = F.col(records.CORRUPT).isNotNull()
    found = parsed.groupBy("corpus", "name").agg(F.max(broken).alias("broken"), F.count("GOID").alias("whole"))
    error = F.when(F.col("broken"), "malformed").when(F.coalesce("whole", F.lit(0)) == 0, "no record")
    log = commits.with_status(todo.select("corpus", "name").distinct().join(found, ["corpus", "name"], "left").withColumn("error", error))
    commits.write_log(log, path, STEP, run)
    commits.mark(spark, path, STEP, run)
    counts = commits.read_log(spark, path, STEP).filter(F.col("run") == run).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "error").alias("errors")).first()
    return counts.asDict()


def read(spark: SparkSession, path: str, tags: Sequence[str] = ()) -> DataFrame:
    """All articles of the store: name, the article columns, tags, corpus, bucket."""
    folders = [f"{path}/articles/run={run}" for run in commits.committed(spark, path, STEP)]
    if not folders:
        return spark.createDataFrame([], schema(tags))
    return spark.read.option("basePath", f"{path}/articles").schema(schema(tags)).parquet(*folders)


def load(spark: SparkSession, path: str, manifest: DataFrame, tags: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Articles of a manifest of (corpus, name), with every expected column, in order.

    What the manifest lists is known before the scan: its corpora (one value a folder of the corpus) and, where they are
    few, its buckets become filters on folders. The join by name then runs over what those folders hold.
    """
    listed = manifest.select("corpus", "name").distinct()
    rows = read(spark, path, tags)
    corpora = [r["corpus"] for r in listed.select("corpus").distinct().collect()]
    rows = rows.filter(F.col("corpus").isin([c for c in corpora if c is not None]))
    places = listed.select("corpus", _bucket(F.col("name"), buckets).alias("bucket")).distinct().limit(LISTED + 1).collect()
    if len(places) <= LISTED:
        rows = rows.filter(F.col("bucket").isin(sorted({p["bucket"] for p in places})))
    kept = rows.join(listed, ["corpus", "name"], "left_semi")
    return records.expected_columns(kept, tags)


def pending(spark: SparkSession, path: str, manifest: DataFrame, progress: str, step: str, tags: Sequence[str] = (),
            buckets: int = BUCKETS) -> DataFrame:
    """Articles of a manifest that a step's log does not hold yet."""
    done = commits.read_log(spark, progress, step).select("corpus", "name")
    return load(spark, path, manifest.join(done, ["corpus", "name"], "left_anti"), tags, buckets)


def errors(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, name, error) of files that gave no article."""
    return commits.read_log(spark, path, STEP).filter(F.col("status") == "error").select("corpus", "name", "error")
