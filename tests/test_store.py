import re

from pressloom.sources import records, store
from pressloom.streaming import commits, incremental
from test_records import record


def write(folder, files):
    for path, xml in files.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(xml)


def goids(df):
    return sorted(r.goid for r in df.collect())


def test_store_grows_by_files_and_keeps_what_it_has(spark, tmp_path):
    files, path = tmp_path / "files", str(tmp_path / "store")
    write(files, {"a/1.xml": record("1"), "a/2.xml": record("2")[:-9], "b/many.xml": f"<R>{record('3')}{record('1')}</R>", "b/x.xml": "<X/>"})
    assert store.add(spark, str(files), path) == {"files": 4, "errors": 2}
    assert store.add(spark, str(files), path) == {"files": 0, "errors": 0}
    assert {(r.corpus, r.name, r.error) for r in store.errors(spark, path).collect()} == {("a", "2.xml", "malformed"), ("b", "x.xml", "no record")}
    write(files, {"a/2.xml": record("2"), "c/5.xml": record("5")})
    assert store.add(spark, str(files), path) == {"files": 1, "errors": 0}
    assert store.add(spark, str(files), path, retry_errors=True) == {"files": 2, "errors": 1}
    rows = store.read(spark, path)
    assert sorted((r.corpus, r.goid) for r in rows.collect()) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "3"), ("c", "5")]


def test_a_failed_addition_leaves_nothing(spark, tmp_path):
    files, path = tmp_path / "files", str(tmp_path / "store")
    write(files, {"a/1.xml": record("1")})
    run = commits.run_id(records.list_files(spark, str(files)), path, store.STEP)
    lost = spark.createDataFrame([("9.xml", "9", "a", 0)], "name string, goid string, corpus string, bucket int")
    lost.write.partitionBy("corpus", "bucket").parquet(f"{path}/articles/run={run}")
    assert store.read(spark, path).count() == 0
    store.add(spark, str(files), path)
    assert goids(store.read(spark, path)) == ["1"]


def test_manifest_reads_its_corpus_and_its_buckets_only(spark, tmp_path):
    """Names clash between corpora; the scan's folders are those of the manifest."""
    files, path = tmp_path / "files", str(tmp_path / "store")
    write(files, {f"{c}/{i}.xml": record(str(i)) for c in "abc" for i in range(6)})
    store.add(spark, str(files), path, buckets=4)
    manifest = spark.createDataFrame([("b", "2.xml"), ("b", "2.xml"), ("b", "nowhere.xml")], "corpus string, name string")
    rows = store.load(spark, path, manifest, ["is_economic"], buckets=4)
    assert rows.columns[0] == "goid" and rows.columns[-1] == "is_economic" and goids(rows) == ["2"]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan, re.S)[1]
    assert "corpus" in filters and "bucket" in filters and "= b" in filters
    several = spark.createDataFrame([("a", "1.xml"), ("c", "1.xml")], "corpus string, name string")
    assert goids(store.load(spark, path, several, buckets=4)) == ["1", "1"]
    assert store.load(spark, path, manifest.limit(0), buckets=4).count() == 0


def test_pending_rows_of_a_step(spark, tmp_path):
    files, path, log = tmp_path / "files", str(tmp_path / "store"), str(tmp_path / "log")
    write(files, {f"a/{i}.xml": record(str(i)) for i in range(4)})
    store.add(spark, str(files), path)
    manifest = spark.createDataFrame([("a", f"{i}.xml") for i in range(4)], "corpus string, name string")
    incremental.append_progress(manifest.filter("name IN ('0.xml', '2.xml')"), log, "s")
    assert goids(store.pending(spark, path, manifest, log, "s")) == ["1", "3"]
    assert goids(store.pending(spark, path, manifest, log, "t")) == ["0", "1", "2", "3"]


def test_records_stay_where_they_are_read(spark, tmp_path):
    files = tmp_path / "files"
    write(files, {"a/1.xml": record("1"), "a/2.xml": record("2"), "b/3.xml": record("3")})
    listed = records.list_files(spark, str(files))
    wanted = listed.filter("name <> '2.xml'").repartition(3)  # of unknown size
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = store._records_of(records.read_records(spark, str(files)), wanted)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r.GOID for r in rows.collect()) == ["1", "3"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stored_records_take_their_language_without_a_join(spark, monkeypatch):
    from pressloom.catalog import records as queries

    seen = []
    monkeypatch.setattr(store, "add", lambda *_: None)
    monkeypatch.setattr(records, "to_records", lambda df, *_, **__: seen.append(df) or df.select("goid", "corpus"))
    queries._stored(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 1
