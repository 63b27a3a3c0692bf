"""Runs that happen wholly or not at all.

A run writes its rows below ``<sink>/run=<id>`` and its log below ``<progress>/step=<step>/run=<id>``, and is committed by one
marker file, ``<progress>/_commits/<step>/<id>``, created after both. Readers see the runs that have a marker, so a run
that failed at any point left nothing behind that counts. The id follows from the step, the runs committed before and
the keys of the pending rows: a repeated run of the same rows gets the same id and writes over what the failed one left.
``sweep`` deletes folders that no marker names.

One writer per step and progress folder is assumed; steps may share both folders.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

LOG = "step string, run string, corpus string, name string, status string, error string"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with a text unless it exists; whether this call made it."""
    fs, found = _path(spark, path)
    try:
        out = fs.create(found, False)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception) or "already exists" in str(e.java_exception):
            return False
        raise
    out.writeBytes(text)
    out.close()
    return True


def text_of(spark: SparkSession, path: str) -> str:
    fs, found = _path(spark, path)
    stream = fs.open(found)
    try:
        return stream.readLine() or ""
    finally:
        stream.close()


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it does not exist."""
    fs, path = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def delete(spark: SparkSession, folder: str) -> None:
    fs, path = _path(spark, folder)
    fs.delete(path, True)


def _markers(progress: str, step: str) -> str:
    return f"{progress}/_commits/{step}"


def committed(spark: SparkSession, progress: str, step: str) -> list[str]:
    """Ids of the committed runs of a step, in order."""
    return children(spark, _markers(progress, step))


def mark(spark: SparkSession, progress: str, step: str, run: str) -> None:
    """Commit a run. Creating one file is atomic on every file system Spark writes to."""
    fs, path = _path(spark, f"{_markers(progress, step)}/{run}")
    fs.create(path, True).close()


def run_id(pending: DataFrame, progress: str, step: str) -> str | None:
    """Id of the run that takes these rows; None if there are none. Reads the keys only."""
    keys = [k for k in ("corpus", "name") if k in pending.columns]
    hash_ = F.xxhash64(*keys)
    found = pending.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(hash_).alias("x"),
                        F.sum(F.pmod(hash_, F.lit(1 << 31))).alias("s")).first()
    if not found["n"]:
        return None
    done = len(committed(pending.sparkSession, progress, step))
    return f"{done:08d}-{found['n']:x}-{found['x'] & (1 << 64) - 1:016x}-{found['s']:x}"


def _data(sink: str, step: str, run: str) -> str:
    return f"{sink}/step={step}/run={run}"


def with_status(out: DataFrame) -> DataFrame:
    """Rows with ``error`` and ``status``; both are added where the steps made none."""
    if "error" not in out.columns:
        out = out.withColumn("error", F.lit(None).cast("string"))
    return out.withColumn("status", F.when(F.col("error").isNotNull(), "error").otherwise("ok"))


def write_data(out: DataFrame, sink: str, step: str, run: str) -> dict:
    """Write a run's rows, good and quarantined ones apart; the counts are taken in the write itself."""
    seen = Observation()
    marked = with_status(out)
    counted = marked.observe(seen, F.count_if(F.col("status") == "ok").alias("processed"),
                             F.count_if(F.col("status") == "error").alias("errors"))
    counted.write.mode("overwrite").partitionBy("status").parquet(_data(sink, step, run))
    return {"processed": 0, "errors": 0} | seen.get


def write_log(rows: DataFrame, progress: str, step: str, run: str) -> None:
    """Write a run's log from rows of (corpus, name, status, error); absent columns are null."""
    kinds = {"corpus": "string", "name": "string", "status": "string", "error": "string"}
    columns = [(F.col(c) if c in rows.columns else F.lit("ok" if c == "status" else None)).cast(t).alias(c) for c, t in kinds.items()]
    rows.select(*columns).write.mode("overwrite").partitionBy("corpus").parquet(f"{progress}/step={step}/run={run}")


def commit(out: DataFrame, sink: str, progress: str, step: str, run: str, key: str = "name") -> dict:
    """Data, log, marker, in this order. Returns the counts."""
    spark = out.sparkSession
    counts = write_data(out, sink, step, run)
    written = spark.read.schema(with_status(out).schema).parquet(_data(sink, step, run))
    keys = written if key == "name" else written.withColumn("name", F.col(key))
    write_log(keys.select(*[c for c in ("corpus", "name", "status", "error") if c in keys.columns]), progress, step, run)
    mark(spark, progress, step, run)
    return counts


def read_rows(spark: SparkSession, sink: str, progress: str, step: str, schema: T.StructType | str, status: str | None = "ok") -> DataFrame:
    """Rows of the committed runs of a step (``status`` None: quarantined ones too), with ``run`` and ``status``."""
    folders = [_data(sink, step, run) for run in committed(spark, progress, step)]
    whole = _with(schema, "run string, status string")
    if not folders:
        return spark.createDataFrame([], whole)
    rows = spark.read.option("basePath", f"{sink}/step={step}").schema(whole).parquet(*folders)
    return rows if status is None else rows.filter(F.col("status") == status)


def _with(schema: T.StructType | str, more: str) -> T.StructType:
    found = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    added = [f for f in T.StructType.fromDDL(more) if f.name not in found.names]
    return T.StructType([*found.fields, *added])


def read_log(spark: SparkSession, progress: str, step: str | None = None) -> DataFrame:
    """(step, run, corpus, name, status, error) of committed runs, of one step or all."""
    steps = children(spark, f"{progress}/_commits") if step is None else [step]
    folders = [f"{progress}/step={s}/run={run}" for s in steps for run in committed(spark, progress, s)]
    if not folders:
        return spark.createDataFrame([], LOG)
    return spark.read.option("basePath", progress).schema(LOG).parquet(*folders).select(*[c.split()[0] for c in LOG.split(", ")])


def sweep(spark: SparkSession, sink: str, progress: str, step: str) -> list[str]:
    """Delete what failed runs of a step left behind; returns their ids. Not beside a running one."""
    done, gone = set(committed(spark, progress, step)), set()
    for root in (f"{sink}/step={step}", f"{progress}/step={step}"):
        for name in children(spark, root):
            if name.startswith("run=") and name.removeprefix("run=") not in done:
                delete(spark, f"{root}/{name}")
                gone.add(name.removeprefix("run="))
    return sorted(gone)

