"""Steps that pick up where they stopped, as batch anti-joins or as a file stream."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.clean import pending
from ..sources.tables import _exists
from . import commits

Transform = Callable[[DataFrame], DataFrame]

read_progress = commits.read_log


def append_progress(rows: DataFrame, path: str, step: str) -> None:
    """Log (corpus, name[, error]) rows as a run of their own; call it after the data is committed."""
    run = commits.run_id(rows, path, step)
    if run is not None:
        commits.write_log(commits.with_status(rows), path, step, run)
        commits.mark(rows.sparkSession, path, step, run)


def still_pending(wanted: DataFrame, progress: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Wanted names the log does not hold; with ``retry_errors`` failed ones come again."""
    done = progress.filter(F.col("status") == "ok") if retry_errors else progress
    keys = [k for k in ("corpus", "name") if k in wanted.columns]
    if keys == ["name"]:
        return pending(wanted, done)
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def run_steps(rows: DataFrame, steps: Sequence[tuple[Callable[..., DataFrame], dict]], sink: str, progress: str,
              step: str, retry_errors: bool = False) -> tuple[dict, DataFrame]:
    """Run a chain of (function, options) over pending rows as one run that is committed wholly or not at all.

    Rows with a non-null ``error`` column are quarantined instead of written. Returns the run's counts
    with its rate, and its failures. All corpora run in one plan; nothing is written when nothing is pending.
    """
    spark, start = rows.sparkSession, time.monotonic()
    todo = still_pending(rows, read_progress(spark, progress, step), retry_errors)
    run = commits.run_id(todo, progress, step)
    out = todo
    for function, options in steps:
        out = out.transform(function, **options)
    if run is None:
        counts, failures = {"processed": 0, "errors": 0}, spark.createDataFrame([], "corpus string, name string, error string")
    else:
        counts = commits.commit(out, sink, progress, step, run)
        failures = read_progress(spark, progress, step).filter((F.col("run") == run) & (F.col("status") == "error"))
    seconds = time.monotonic() - start
    rate = round((counts["processed"] + counts["errors"]) / seconds, 2)
    return {**counts, "seconds": round(seconds, 1), "rate": rate}, failures.select("corpus", "name", "error")


def run_stream(source: DataFrame, transform: Transform, sink: str, progress: str, step: str, checkpoint: str,
               key: str = "name") -> None:
    """Process every file not seen before and stop. A replayed batch writes over its own run, so a
    failure between data and log repeats nothing."""
    def commit(batch: DataFrame, batch_id: int) -> None:
        commits.commit(transform(batch), sink, progress, step, f"batch-{batch_id:012d}", key)

    query = (
        source.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_files(spark: SparkSession, folder: str, schema: T.StructType, glob: str, fmt: str = "parquet",
                 files_per_batch: int = 1000, **options) -> DataFrame:
    """A file stream with an explicit schema."""
    return (
        spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch).options(**options).load(folder)
    )


def build_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The saved table if it exists, else build, save and read it."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
