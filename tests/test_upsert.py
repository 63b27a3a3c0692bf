from pyspark.sql import functions as F

from pressloom.operators import upsert


def base(spark):
    return spark.createDataFrame([("1", 0.5), ("2", None), ("3", 0.0)], "goid string, score double")


def values(df, column="score"):
    return {r.goid: r[column] for r in df.collect()}


def test_keep_never_loses_a_value_or_row(spark):
    new = spark.createDataFrame([("1", 0.9), ("2", 0.8)], "goid string, score double")
    once = upsert.set_columns(base(spark), new, ["score"], modify=False)
    assert values(once) == {"1": 0.5, "2": 0.8, "3": 0.0}
    assert values(upsert.set_columns(once, new, ["score"], modify=False)) == values(once)


def test_overwrite_and_new_column(spark):
    new = spark.createDataFrame([("1", 0.9), ("2", None)], "goid string, fresh double")
    assert values(upsert.set_columns(base(spark), new, {"fresh": "score"})) == {"1": 0.9, "2": None, "3": 0.0}
    assert values(upsert.set_columns(base(spark), new, ["fresh"]), "fresh") == {"1": 0.9, "2": None, "3": None}


def test_delete_tag(spark):
    row = spark.createDataFrame([({"grades": "x", "is_economic": "1"},)], "tags map<string,string>")
    assert row.select(upsert.delete_tag(F.col("tags"), "grades").alias("t")).first().t == {"is_economic": "1"}


def test_table_to_records(spark):
    table = spark.createDataFrame([(1, "0.123456"), (1, "0.1"), (3, "7"), (2, "bad"), (None, "1")], "goid bigint, v string")
    names = spark.createDataFrame([("1.xml",), ("2.xml",)], "name string")
    records, updated = upsert.table_to_records(base(spark), table, {"v": "score"}, names)
    assert values(records) == {"1": 0.1235, "2": None, "3": 0.0}
    assert sorted(r.name for r in updated.collect()) == ["1.xml", "2.xml"]


def test_records_to_table(spark):
    table = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "goid bigint, tag string")
    records = spark.createDataFrame([("1", "new", "x"), ("2", None, "y")], "goid string, tag string, extra string")
    out = upsert.records_to_table(table, records, ["tag", "extra"])
    assert values(out, "tag") == {1: "new", 2: None, 3: "old"} and values(out, "extra") == {1: "x", 2: "y", 3: None}


def test_rescore(spark):
    assert values(upsert.rescore_missing(base(spark), "score", F.lit(0.7))) == {"1": 0.5, "2": 0.7, "3": 0.7}


def test_updates_that_repeat_a_key_multiply_nothing(spark):
    base = spark.createDataFrame([("1", "old"), ("2", None)], "goid string, tag string")
    updates = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("2", None)], "goid string, tag string")
    assert sorted(map(tuple, upsert.set_columns(base, updates, ["tag"]).collect())) == [("1", "b"), ("2", "c")]
    assert sorted(map(tuple, upsert.records_to_table(base, updates, ["tag"]).collect())) == [("1", "b"), ("2", "c")]
