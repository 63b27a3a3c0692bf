from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pressloom.operators import clean
from pressloom.schema import EXPORT_COLUMNS
from pressloom.sources import tables


def test_names(spark, tmp_path):
    path = tmp_path / "economic_files.txt"
    path.write_text("1.xml\n\n  2.xml \n")
    assert sorted(r.name for r in tables.read_names(spark, str(path)).collect()) == ["1.xml", "2.xml"]
    tables.write_names(spark.createDataFrame([("a",)], "name string"), str(tmp_path / "out"))
    tables.write_names(spark.createDataFrame([("b",)], "name string"), str(tmp_path / "out"))
    assert sorted(r.name for r in tables.read_names(spark, str(tmp_path / "out")).collect()) == ["a", "b"]


def test_chunks_count_blank_lines(spark):
    lines = spark.createDataFrame([(0, "a"), (1, " "), (2, "b"), (3, "c"), (4, "")], "i int, name string")
    got = sorted(tuple(r) for r in tables.numbered_chunks(lines, 2, ["i"]).select("name", "chunk").collect())
    assert got == [("a", 0), ("b", 1), ("c", 1)]


def test_csv_folder(spark, tmp_path):
    schema = "goid string, note string"
    assert tables.read_csv_folder(spark, str(tmp_path / "none"), schema).count() == 0
    (tmp_path / "e").mkdir()
    assert tables.read_csv_folder(spark, str(tmp_path / "e"), schema).columns == ["goid", "note"]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "chunk_0_data.csv").write_text('goid,note\n1,"two\nlines, ""quoted"""\n')
    (tmp_path / "a" / "chunk_1_data.csv").write_text("goid,note\n2,x\n")
    (tmp_path / "a" / "readme.txt").write_text("no")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "chunk_10_data.csv").write_text("goid,other\n3,y\n")
    both = tables.read_csv_folders(spark, {str(tmp_path / "a"): schema, str(tmp_path / "b"): "goid string, other string"})
    assert sorted((tuple(r) for r in both.collect()), key=repr) == [
        ("1", 'two\nlines, "quoted"', None), ("2", "x", None), ("3", None, "y")]
    listed = tables.list_chunks(spark, str(tmp_path))
    assert [(r.name, r.number) for r in listed.collect()] == [("chunk_0_data.csv", 0), ("chunk_1_data.csv", 1), ("chunk_10_data.csv", 10)]


def test_chunk_files_hold_at_most_the_row_limit(spark, tmp_path):
    rows = spark.range(95).select(F.col("id").cast("string").alias("goid"), F.array(F.lit("a"), F.lit('b "c"')).alias("paragraph_text"))
    tables.write_chunks(rows.coalesce(1), str(tmp_path / "r"), 20)
    files = list(Path(tmp_path / "r").glob("*.csv"))
    assert len(files) == 5 and "paragrph_text" in files[0].read_text().splitlines()[0]


def test_chunk_numbers_continue(spark, tmp_path):
    folder = str(tmp_path / "r")
    rows = spark.range(25).select(F.col("id").cast("string").alias("goid"))
    tables.append_chunks(rows, folder, ["goid"], 10)
    tables.append_chunks(rows, folder, ["goid"], 10)
    sizes = {int(p.name.split("=")[1]): sum(len(f.read_text().splitlines()) - 1 for f in p.glob("*.csv")) for p in Path(folder).glob("chunk=*")}
    assert sizes == {0: 10, 1: 10, 2: 5, 3: 10, 4: 10, 5: 5}


def test_export_needs_every_column(spark):
    row = spark.range(1).select(*[F.lit("x").alias(c) for c in EXPORT_COLUMNS], F.lit("t").alias("text"))
    assert tables.export(row).columns == list(EXPORT_COLUMNS)
    with pytest.raises(Exception, match="is_economic"):
        tables.export(row.drop("is_economic")).columns


def test_sample_of_files(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.sample_files(spark, str(tmp_path), 3)
    for i in range(6):
        (tmp_path / f"c{i % 2}").mkdir(exist_ok=True)
        (tmp_path / f"c{i % 2}" / f"{i}.xml").write_text("<RECORD/>")
    got = [r.path for r in tables.sample_files(spark, str(tmp_path), 4).collect()]
    assert len(set(got)) == 4 and all(p.split("/")[0] in ("c0", "c1") for p in got)
    assert tables.sample_files(spark, str(tmp_path), 40).count() == 6


def test_tag_lines(spark):
    counts = spark.createDataFrame([(f"t{i}", 100 - i // 2) for i in range(8)], "tag string, count bigint")
    got = [(r.line, r.value) for r in tables.tag_lines(counts).orderBy("line").collect()]
    assert got == [(0, "t0, t1, t2, t3, t4, t5"), (1, "t6, t7")]


def test_text_join_and_lookup(spark):
    arts = spark.createDataFrame([("x", "1", ["a"]), ("y", "2", ["b"])], "corpus string, goid string, paragraph_text array<string>")
    out = tables.with_text(spark.createDataFrame([(1,), (3,)], "goid bigint"), arts)
    assert {r.goid: r.texts for r in out.collect()} == {1: ["a"], 3: None}
    assert tables.find_article(arts, "y", 2).first().paragraph_text == ["b"] and tables.find_article(arts, "x", 2).count() == 0


def test_word_lists(spark, tmp_path):
    (tmp_path / "stop").write_text("the\na\n\nthe\n")
    assert sorted(r.word for r in tables.read_words(spark, str(tmp_path / "stop")).collect()) == ["a", "the"]
    assert tables.page_sizes(spark).count() == 5 and tables.publisher_aliases(spark).count() == 5


def test_tags_and_publishers(spark):
    tags = clean.economic_tags(spark)
    assert tags.count() == tags.distinct().count() > 100 and tags.filter("tag = 'tarp funds'").count() == 1
    rows = spark.createDataFrame([("Banks",), ("banks",), (None,)], "t string")
    assert clean.with_tags(rows, tags, "t").count() == 1 and clean.with_tags(rows, tags, "t", case_insensitive=True).count() == 2
    pubs = spark.createDataFrame([("New York Times Español",), (None,), ("New York Times The",)], "publisher string")
    assert [r[0] for r in clean.exclude_publisher(clean.fold_publishers(pubs)).collect()] == [None, "new york times"]


def test_year_bounds_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "date_add(date'2003-12-28', cast(id as int)) as date").write.parquet(str(tmp_path / "t"))
    kept = clean.years(spark.read.parquet(str(tmp_path / "t")), 2003, 2024)
    assert kept.count() == 6
    assert "GreaterThanOrEqual(date,2004-01-01)" in kept._jdf.queryExecution().executedPlan().toString()


def test_first_copy_survives(spark):
    rows = spark.createDataFrame([("1", "2010-01-02", "a"), ("1", "2010-01-01", "b"), ("2", "2010-01-01", "b")], "goid string, date string, text string")
    assert sorted((r.goid, r.text) for r in clean.distinct_by_key(rows).collect()) == [("1", "b"), ("2", "b")]
    once = clean.distinct_by_text(rows, F.col("text"))
    assert sorted((r.goid, r.text) for r in once.collect()) == [("1", "a"), ("1", "b")]
    assert once.columns == rows.columns and clean.distinct_by_text(once, F.col("text")).count() == 2


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Files of several splits, with blank lines and without a last line end."""
    want = {}
    for name, n in (("a.txt", 5000), ("b.txt", 1), ("c.txt", 700)):
        lines = ["" if i % 7 == 3 else f"name {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "a.txt" else ""))
        want |= {(name, i + 1): line for i, line in enumerate(lines) if line or i < n}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = tables.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        assert {(r.file.rsplit("/", 1)[1], r.line): r.value for r in lines.collect()} == want
        chunks = [r for r in tables.chunks_of_file(spark, str(tmp_path / "a.txt"), 100).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.name, r.chunk) for r in chunks} == {(v.strip(), (i - 1) // 100) for (f, i), v in want.items() if f == "a.txt" and v.strip()}


def test_chunk_numbers_of_two_writers_never_clash(spark, tmp_path):
    folder = str(tmp_path / "c")
    assert [tables.reserve_chunks(spark, folder, n) for n in (3, 1, 2)] == [0, 3, 4]
    rows = spark.range(10).select(F.col("id").alias("n"))
    assert tables.append_chunks(rows, folder, ["n"], 4) == (6, 3)
    (tmp_path / "c" / "chunk=20").mkdir()  # written by something that reserves nothing
    assert tables.append_chunks(rows, folder, ["n"], 5) == (21, 2) and tables.append_chunks(rows.limit(0), folder, ["n"]) == (0, 0)
    found = tables.read_chunks(spark, folder, "n bigint").groupBy("chunk").agg(F.count("n").alias("k")).collect()
    assert {r.chunk: r.k for r in found} == {6: 4, 7: 4, 8: 2, 21: 5, 22: 5}
    (tmp_path / "c" / "_reserved" / "000000000023").touch()
    import pytest

    with pytest.raises(RuntimeError, match="reserves no numbers"):
        tables.reserve_chunks(spark, folder, 1, wait=0.2)


def test_text_of_a_repeated_article_is_joined_once(spark):
    articles = spark.createDataFrame([("1", ["b"]), ("1", ["a"])], "goid string, paragraph_text array<string>")
    results = spark.createDataFrame([("1", 0.5)], "goid string, v double")
    assert [r.texts for r in tables.with_text(results, articles).collect()] == [["a"]]
