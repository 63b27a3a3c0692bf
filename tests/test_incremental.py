import shutil

import pytest
from pyspark.sql import functions as F

from pressloom.streaming import commits, incremental


def rows(spark, names):
    return spark.createDataFrame([(f"c{int(n) % 2}", n, f"text {n}") for n in names], "corpus string, name string, text string")


def add_tag(df, tag="test_tag"):
    return df.withColumn(tag, F.lit("1"))


def fail_on(df, name):
    return df.withColumn("error", F.when(F.col("name") == name, "boom"))


def counts(result):
    return {k: result[0][k] for k in ("processed", "errors")}


def test_step_chain_adds_a_tag(spark, tmp_path):
    stats, failures = incremental.run_steps(rows(spark, "1"), [(add_tag, {})], str(tmp_path / "d"), str(tmp_path / "p"), "s")
    assert counts((stats,)) == {"processed": 1, "errors": 0} and stats["rate"] > 0 and failures.count() == 0
    assert spark.read.parquet(str(tmp_path / "d")).first().test_tag == "1"


def test_resume_quarantine_and_retry(spark, tmp_path):
    data, log = str(tmp_path / "d"), str(tmp_path / "p")
    run = lambda names, steps, **o: incremental.run_steps(rows(spark, names), steps, data, log, "s", **o)
    stats, failures = run("123", [(fail_on, {"name": "2"})])
    assert counts((stats,)) == {"processed": 2, "errors": 1} and [tuple(r) for r in failures.collect()] == [("c0", "2", "boom")]
    assert counts(run("1234", [(add_tag, {})])) == {"processed": 1, "errors": 0}
    assert counts(run("1234", [(add_tag, {})], retry_errors=True)) == {"processed": 1, "errors": 0}
    assert counts(run("1234", [(add_tag, {})], retry_errors=True)) == {"processed": 0, "errors": 0}
    log_rows = sorted((r.name, r.status) for r in incremental.read_progress(spark, log, "s").collect())
    assert log_rows == [("1", "ok"), ("2", "error"), ("2", "ok"), ("3", "ok"), ("4", "ok")]
    # another step keeps its own log
    assert incremental.read_progress(spark, log, "other").count() == 0


def test_pending_keeps_repeated_names(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    done = spark.createDataFrame([("s", "r", "c", "a", "ok", None)], commits.LOG)
    assert [r.name for r in incremental.still_pending(wanted, done).collect()] == ["b", "b"]


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = rows(spark, "1").schema

    def add(n):
        rows(spark, n).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        stream = incremental.stream_files(spark, str(src), schema, "*.parquet", files_per_batch=1)
        incremental.run_stream(stream, add_tag, out, str(tmp_path / "p"), "s", str(tmp_path / "ck"))
        return sorted(r.name for r in spark.read.parquet(out).collect())

    add("12")
    add("3")
    assert run() == ["1", "2", "3"] and run() == ["1", "2", "3"]
    add("4")
    assert run() == ["1", "2", "3", "4"]
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_replayed_batch_repeats_nothing(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    rows(spark, "12").coalesce(1).write.parquet(str(src))
    for _ in range(2):
        stream = incremental.stream_files(spark, str(src), rows(spark, "1").schema, "*.parquet")
        incremental.run_stream(stream, add_tag, out, str(tmp_path / "p"), "s", str(tmp_path / "ck"))
        shutil.rmtree(tmp_path / "ck")  # the stream forgets, as after a crash before its commit
    assert spark.read.parquet(out).count() == 2


def test_build_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert incremental.build_once(spark, path, lambda: spark.range(3)).count() == 3
    assert incremental.build_once(spark, path, lambda: pytest.fail("built twice")).count() == 3


def test_a_run_that_failed_anywhere_is_repeated_whole(spark, tmp_path):
    """Fail before the data, between data and log, between log and marker: the next run equals a single one."""
    wanted = rows(spark, "12345")
    for stop in ("none", "data", "log"):
        data, log = str(tmp_path / stop / "d"), str(tmp_path / stop / "p")
        first = rows(spark, "12")
        incremental.run_steps(first, [(add_tag, {})], data, log, "s")
        todo = incremental.still_pending(wanted, incremental.read_progress(spark, log, "s"))
        run = commits.run_id(todo, log, "s")
        out = fail_on(todo, "4")
        if stop != "none":
            commits.write_data(out, data, "s", run)
        if stop == "log":
            commits.write_log(commits.with_status(out), log, "s", run)
        schema = "corpus string, name string, text string, error string"
        assert commits.read_rows(spark, data, log, "s", schema).count() == 2  # nothing of the failed run counts
        assert incremental.read_progress(spark, log, "s").count() == 2
        stats, failures = incremental.run_steps(wanted, [(fail_on, {"name": "4"})], data, log, "s")
        assert counts((stats,)) == {"processed": 2, "errors": 1} and [r.name for r in failures.collect()] == ["4"]
        assert sorted(r.name for r in commits.read_rows(spark, data, log, "s", schema).collect()) == ["1", "2", "3", "5"]
        assert [r.name for r in commits.read_rows(spark, data, log, "s", schema, status="error").collect()] == ["4"]
        assert sorted((r.name, r.status) for r in incremental.read_progress(spark, log, "s").collect()) == [
            ("1", "ok"), ("2", "ok"), ("3", "ok"), ("4", "error"), ("5", "ok")]
        assert commits.sweep(spark, data, log, "s") == []  # the repeated run wrote over the failed one


def test_leftovers_are_swept_when_other_rows_were_pending(spark, tmp_path):
    data, log = str(tmp_path / "d"), str(tmp_path / "p")
    lost = commits.run_id(rows(spark, "12"), log, "s")
    commits.write_data(rows(spark, "12"), data, "s", lost)
    incremental.run_steps(rows(spark, "123"), [(add_tag, {})], data, log, "s")
    schema = "corpus string, name string, test_tag string"
    assert commits.read_rows(spark, data, log, "s", schema).count() == 3
    assert commits.sweep(spark, data, log, "s") == [lost] and commits.sweep(spark, data, log, "s") == []
    assert commits.read_rows(spark, data, log, "s", schema).count() == 3


def test_run_ids_follow_from_step_state_and_rows(spark, tmp_path):
    log = str(tmp_path / "p")
    a, b = commits.run_id(rows(spark, "12"), log, "s"), commits.run_id(rows(spark, "21").repartition(3), log, "s")
    assert a == b != commits.run_id(rows(spark, "13"), log, "s") and commits.run_id(rows(spark, "1").limit(0), log, "s") is None
    commits.mark(spark, log, "s", a)
    assert commits.run_id(rows(spark, "12"), log, "s") != a == commits.run_id(rows(spark, "12"), log, "t")
    assert commits.committed(spark, log, "s") == [a] and commits.committed(spark, log, "t") == []


def test_streams_of_two_steps_share_folders(spark, tmp_path):
    src, out, log = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "p")
    rows(spark, "12").coalesce(1).write.parquet(str(src))
    for step in ("s", "t"):
        stream = incremental.stream_files(spark, str(src), rows(spark, "1").schema, "*.parquet")
        incremental.run_stream(stream, lambda b: fail_on(b, "2"), out, log, step, str(tmp_path / f"ck-{step}"))
    found = sorted((r.step, r.name, r.status, r.error) for r in incremental.read_progress(spark, log).collect())
    assert found == [(s, n, *x) for s in "st" for n, x in (("1", ("ok", None)), ("2", ("error", "boom")))]
    for step in "st":
        assert [r.name for r in commits.read_rows(spark, out, log, step, rows(spark, "1").schema).collect()] == ["1"]


def test_nothing_pending_writes_nothing(spark, tmp_path):
    data, log = tmp_path / "d", str(tmp_path / "p")
    stats, failures = incremental.run_steps(rows(spark, "1").limit(0), [(add_tag, {})], str(data), log, "s")
    assert counts((stats,)) == {"processed": 0, "errors": 0} and failures.count() == 0 and not data.exists()
