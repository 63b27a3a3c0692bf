"""Tags of articles as a table of their own: narrow versions beside the texts, merged when read.

Every step writes (corpus, goid, its columns) as a run that is committed wholly or not at all; the articles, with their
texts, stay where they are and no join carries them. A reader merges the versions per article and column: the last
version that may overwrite wins, and without one the first value stays; a null never replaces a value. ``compact``
writes the merged table as one version and the versions before it no longer count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..streaming import commits

STEP = "enrichment"
KEYS = ("corpus", "goid")
#: End of a compacted run's id: runs before it are held in it.
COMPACTED = "-compacted"
MODIFY = "_modify"


def _schema(columns: str) -> T.StructType:
    return T.StructType([*T.StructType.fromDDL("corpus string, goid string").fields, *T.StructType.fromDDL(columns).fields,
                         T.StructField(MODIFY, T.BooleanType()), T.StructField("run", T.StringType())])


def _folder(path: str, run: str) -> str:
    return f"{path}/versions/run={run}"


def _write(rows: DataFrame, path: str, run: str) -> None:
    rows.write.mode("overwrite").parquet(_folder(path, run))
    commits.mark(rows.sparkSession, path, STEP, run)


def write(values: DataFrame, path: str, modify: bool = True) -> str | None:
    """Commit a version: ``values`` has corpus, goid and the columns to set. Rows that repeat an article count once, with
    their greatest value per column. Without ``modify`` values that are there already stay. Returns the run's id."""
    names = [c for c in values.columns if c not in KEYS]
    rows = values.withColumn("goid", F.col("goid").cast("string")).groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in names])
    run = commits.run_id(values.select("corpus", F.col("goid").cast("string").alias("name")), path, STEP)
    if run is not None:
        _write(rows.withColumn(MODIFY, F.lit(modify)), path, run)
    return run


def live(spark: SparkSession, path: str) -> list[str]:
    """Ids of the runs that count: the last compacted one and all after it."""
    runs = commits.committed(spark, path, STEP)
    last = max([i for i, run in enumerate(runs) if run.endswith(COMPACTED)], default=0)
    return runs[last:]


def read(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """(corpus, goid, columns): one row per article that any version knows; ``columns`` is DDL."""
    schema = _schema(columns)
    names = T.StructType.fromDDL(columns).names
    folders = [_folder(path, run) for run in live(spark, path)]
    if not folders:
        return spark.createDataFrame([], schema).select(*KEYS, *names)
    versions = spark.read.option("basePath", f"{path}/versions").schema(schema).parquet(*folders)

    def merged(name: str):
        there, may = F.col(name).isNotNull(), F.col(MODIFY)
        last = F.max_by(name, F.when(there & may, F.col("run")))
        first = F.min_by(name, F.when(there & ~may, F.col("run")))
        return F.coalesce(last, first).alias(name)

    # versions of an article are few; each task merges its own before the shuffle
    return versions.groupBy(*KEYS).agg(*[merged(n) for n in names])


def compact(spark: SparkSession, path: str, columns: str) -> str | None:
    """Write the merged table as one version. Readers that have begun still find the versions before it."""
    runs = commits.committed(spark, path, STEP)
    if not runs:
        return None
    run = f"{len(runs):08d}{COMPACTED}"
    # a value that is there may be overwritten later, and overwrites nothing that comes before it
    _write(read(spark, path, columns).withColumn(MODIFY, F.lit(True)), path, run)
    return run


def drop_compacted(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of versions that a compacted one holds, and of failed runs; returns their ids."""
    kept, gone = set(live(spark, path)), []
    for name in commits.children(spark, f"{path}/versions"):
        if name.startswith("run=") and name.removeprefix("run=") not in kept:
            commits.delete(spark, f"{path}/versions/{name}")
            gone.append(name.removeprefix("run="))
    return gone


def attach(articles: DataFrame, tags: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Articles with tag columns. Select the columns that are needed first: what stands in ``articles`` is joined."""
    return articles.join(tags.select(*KEYS, *columns), list(KEYS), "left")


def missing(articles: DataFrame, tags: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(corpus, goid) of articles that lack one of the columns."""
    done = tags.filter(F.forall(F.array(*[F.col(c).isNotNull() for c in columns]), lambda x: x)).select(*KEYS)
    return articles.select(*KEYS).join(done, list(KEYS), "left_anti")
