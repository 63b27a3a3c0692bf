import re

from pyspark.sql import functions as F

from pressloom.operators import sentiment
from pressloom.plans import steps
from pressloom.sources import enrichment
from pressloom.streaming import commits, incremental

COLUMNS = "a double, b string"


def values(spark, rows):
    return spark.createDataFrame(rows, "corpus string, goid string, a double, b string")


def table(spark, path):
    return sorted(map(tuple, enrichment.read(spark, path, COLUMNS).collect()))


def test_versions_merge_as_the_single_edits_would(spark, tmp_path):
    """Against a plain dictionary that takes the same versions one after the other, with and without compaction."""
    import random

    rng, path, plain = random.Random(3), str(tmp_path / "e"), {}
    for step in range(8):
        rows = [(rng.choice("xy"), str(rng.randrange(4)), rng.choice([None, float(step)]), rng.choice([None, f"v{step}"])) for _ in range(5)]
        modify = bool(rng.randrange(2))
        enrichment.write(values(spark, rows), path, modify)
        for key in {r[:2] for r in rows}:
            new = [max((r[i] for r in rows if r[:2] == key and r[i] is not None), default=None) for i in (2, 3)]
            old = plain.get(key, (None, None))
            plain[key] = tuple((n if n is not None else o) if modify else (o if o is not None else n) for n, o in zip(new, old))
        if step == 4:
            enrichment.compact(spark, path, COLUMNS)
            assert len(enrichment.live(spark, path)) == 1
        assert table(spark, path) == sorted((*k, *v) for k, v in plain.items())
    gone = enrichment.drop_compacted(spark, path)
    assert len(gone) == 5 and table(spark, path) == sorted((*k, *v) for k, v in plain.items())


def test_a_version_that_failed_does_not_count_and_is_written_over(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = values(spark, [("x", "1", 1.0, "p")])
    run = commits.run_id(rows.select("corpus", F.col("goid").alias("name")), path, enrichment.STEP)
    rows.withColumn("_modify", F.lit(True)).write.parquet(f"{path}/versions/run={run}")
    assert table(spark, path) == [] and enrichment.write(rows, path) == run and table(spark, path) == [("x", "1", 1.0, "p")]
    assert enrichment.write(rows.limit(0), path) is None and enrichment.compact(spark, str(tmp_path / "none"), COLUMNS) is None


def test_missing_and_attached_columns(spark, tmp_path):
    path = str(tmp_path / "e")
    enrichment.write(values(spark, [("x", "1", 1.0, "p"), ("x", "2", 1.0, None)]), path)
    articles = spark.createDataFrame([("x", "1", "t"), ("x", "2", "t"), ("y", "1", "t")], "corpus string, goid string, title string")
    tags = enrichment.read(spark, path, COLUMNS)
    assert sorted(map(tuple, enrichment.missing(articles, tags, ["a", "b"]).collect())) == [("x", "2"), ("y", "1")]
    assert sorted((r.corpus, r.goid, r.a) for r in enrichment.attach(articles, tags, ["a"]).collect()) == [("x", "1", 1.0), ("x", "2", 1.0), ("y", "1", None)]


def exchanged(df):
    """Columns that the exchanges of a plan carry."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    blocks = re.findall(r"\(\d+\) (\w*Exchange)\nInput \[\d+\]: \[(.*?)\]", plan)
    return [columns for kind, columns in blocks if kind in ("Exchange", "ShuffleExchange")]


def test_no_exchange_of_a_step_carries_a_text(spark, monkeypatch):
    scorer = sentiment.RuleScorer(lambda t: F.when(t == "good", 1).when(t == "bad", -1).otherwise(0), 3)
    articles = spark.createDataFrame([("x", str(i), "good day", ["bad day", "good"]) for i in range(50)],
                                     "corpus string, goid string, title string, paragraph_text array<string>")
    caught = []
    monkeypatch.setattr(steps, "materialise", lambda df, name: caught.append(df) or df)
    monkeypatch.setattr(steps.enrichment, "write", lambda df, path, modify: None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps.enrich_sentiment(articles, scorer, {"positive": "title_positive"}, {"negative": "body_negative"}, "nowhere")
        carried = exchanged(caught[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert carried and not any("title#" in c or "paragraph" in c for c in carried)


def test_economic_selection_resumes(spark, tmp_path):
    sink, log = str(tmp_path / "d"), str(tmp_path / "p")
    rows = spark.createDataFrame([("x", f"{i}.xml", None if i == 5 else f"text {i}") for i in range(6)], "corpus string, name string, text string")
    seen = []

    def score(df):
        seen.append(df.count())
        return df.withColumn("is_economic", F.when(F.col("text").isNotNull(), F.regexp_extract("name", r"\d+", 0).cast("double") / 4))

    steps.run_selection(rows.filter("name < '2.xml'"), score, sink, log)
    stats, failures = steps.run_selection(rows, score, sink, log)
    assert seen == [2, 4] and stats["processed"] == 3 and [r.name for r in failures.collect()] == ["5.xml"]
    chosen = steps.selection(spark, sink, log)
    assert sorted((r.name, r.selected) for r in chosen.collect()) == [(f"{i}.xml", i > 2) for i in range(5)]
    assert {r.status for r in incremental.read_progress(spark, log, "economic").collect()} == {"ok", "error"}


def test_export_continues_a_folder_for_pending_names(spark, tmp_path):
    from pressloom.sources import tables

    folder, log = str(tmp_path / "c"), str(tmp_path / "p")
    rows = spark.createDataFrame([("x", f"{i}.xml", i) for i in range(7)], "corpus string, name string, n int")
    assert steps.export_pending(rows.filter("n < 3"), folder, log, rows=2) == 2
    assert steps.export_pending(rows, folder, log, rows=2) == 2 and steps.export_pending(rows, folder, log, rows=2) == 0
    got = sorted((r.chunk, r.n) for r in tables.read_chunks(spark, folder, "corpus string, name string, n int").collect())
    assert got == [(0, 0), (0, 1), (1, 2), (2, 3), (2, 4), (3, 5), (3, 6)]
