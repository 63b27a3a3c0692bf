"""Balanced building blocks on skewed keys: a third of the rows share one key."""

import os

from pyspark.sql import functions as F

from pressloom.operators import scale
from pressloom.session import CLEANUP, materialise, scratch, shared_dir


def skewed(spark, n=3000):
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    return spark.range(n).select("id", key.cast("long").alias("key"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_rank(spark):
    rows = scale.global_rank(skewed(spark), F.col("key"), F.col("id")).collect()
    want = sorted((r.key, r.id) for r in rows)
    assert {(r.key, r.id): r.rn for r in rows} == {k: i + 1 for i, k in enumerate(want)}


def test_split_lookup_equals_broadcast(spark):
    facts = skewed(spark)
    table = facts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("key % 2 = 0").withColumn("v", F.col("key") * 10)
    expected = sorted(tuple(r) for r in scale.lookup_join(facts, table, "key", "n").select("id", "v").collect())
    split = scale.lookup_join(facts, table, "key", "n", limit=5)
    assert sorted(tuple(r) for r in split.select("id", "v").collect()) == expected
    assert "Union" in plan(split)
    left = scale.lookup_join(facts, table, "key", "n", how="left", limit=5).collect()
    assert len(left) == 3000 and sum(r.v is None for r in left) == 3000 - len(expected)


def test_split_semi_join_equals_broadcast(spark):
    facts = skewed(spark)
    keys = facts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("key % 5 = 0")
    for how in ("left_semi", "left_anti"):
        whole = sorted(r.id for r in scale.semi_join_counted(facts, keys, "key", "n", how).collect())
        split = sorted(r.id for r in scale.semi_join_counted(facts, keys, "key", "n", how, limit=3).collect())
        assert whole == split and whole


def test_salted_join_equals_plain_join(spark):
    facts = skewed(spark)
    table = spark.range(0, 500, 2).select(F.col("id").alias("key"), (F.col("id") * 7).alias("v"))
    plain = sorted(tuple(r) for r in facts.join(table, "key").select("id", "key", "v").collect())
    for options in ({"per_task": 50}, {"per_task": 50, "limit": 4}, {}):
        salted = scale.salted_join(facts, table, "key", "id", **options).select("id", "key", "v")
        assert sorted(tuple(r) for r in salted.collect()) == plain


def test_sample_is_exact_and_repeatable(spark):
    rows = spark.range(5000).select(F.concat(F.col("id").cast("string"), F.lit(".xml")).alias("name"))
    first = sorted(r.name for r in scale.sample_rows(rows, "name", 777, seed=3).collect())
    again = sorted(r.name for r in scale.sample_rows(rows.repartition(13), "name", 777, seed=3).collect())
    other = sorted(r.name for r in scale.sample_rows(rows, "name", 777, seed=4).collect())
    assert len(first) == len(set(first)) == 777 and first == again != other
    assert scale.sample_rows(rows, "name", 9000).count() == 5000


def test_first_per_key_is_pruned_before_the_shuffle(spark):
    out = scale.first_per_key(skewed(spark), ["key"], ["id"])
    text = plan(out)
    assert text.count("WindowGroupLimit") >= 2 and text.rindex("WindowGroupLimit") > text.index("Exchange")
    want = {}
    for r in skewed(spark).collect():
        want[r.key] = min(want.get(r.key, r.id), r.id)
    assert {r.key: r.id for r in out.collect()} == want


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_first_per_key_breaks_ties_by_all_columns(spark):
    from pressloom.operators import clean

    rows = spark.createDataFrame([(1, "2001-01-01", v) for v in range(6)], "goid long, date string, v int")
    assert len({clean.distinct_by_key(rows.repartition(n, "v")).first().v for n in (1, 2, 3, 5)}) == 1


def test_scratch_drops_its_tables_and_keeps_the_result(spark):
    folder = shared_dir(spark).removeprefix("file:")
    with scratch(spark):
        inner = materialise(skewed(spark).groupBy("key").count(), "scratch-inner")
        with scratch(spark):
            kept = materialise(inner.filter("key < 10"), "scratch-kept", keep=True)
        result = materialise(kept.join(inner, ["key", "count"]), "scratch-result", keep=True)
    assert result.count() == 10
    assert {n.rsplit("-", 1)[0] for n in os.listdir(folder) if n.startswith("scratch-")} == {"scratch-result"}


def test_materialise_leaves_no_shuffle_files_and_the_setting_alone(spark):
    before = spark.conf.get(CLEANUP, None)
    table = materialise(skewed(spark).groupBy("key").count(), "counted")
    assert spark.conf.get(CLEANUP, None) == before
    assert table.agg(F.sum("count")).first()[0] == 3000


def test_frequent_keys_that_the_table_lacks_are_not_shuffled(spark):
    """Half of all rows have a key that the table lacks, a fifth one that it has, a tenth none."""
    key = F.when(F.col("id") % 2 == 0, 7_000_000).when(F.col("id") % 10 < 4, 1).when(F.col("id") % 10 == 5, None).otherwise(F.col("id"))
    facts = materialise(spark.range(20_000).select("id", key.cast("long").alias("key")), "facts")
    table = spark.range(0, 20_000, 3).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v")).union(spark.sql("SELECT 1L, 2L"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hot = scale.hot_hashes(facts, "key")
        want = {r.h for r in facts.filter("key IN (1, 7000000) OR key IS NULL").select(F.xxhash64("key").alias("h")).distinct().collect()}
        assert set(hot) == want
        for how in ("inner", "left", "left_semi", "left_anti"):
            plain = facts.join(table, "key", how)
            split = scale.lookup_join(facts, table, "key", how=how, limit=5, absent=True)
            assert split.columns == plain.columns
            assert sorted(map(tuple, split.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
            text = plan(split)
            assert "BroadcastHashJoin" in text and "Union" in text
            # what goes through the shuffle of facts has none of the hot keys
            cold = facts.filter(F.col("key").isNotNull() & ~F.xxhash64("key").isin(hot))
            assert cold.groupBy("key").count().agg(F.max("count")).first()[0] == 1
            shuffled = text[text.index("SortMergeJoin") :] if "SortMergeJoin" in text else text[text.index("ShuffledHashJoin") :]
            assert "INSET" in shuffled or "xxhash64(key" in shuffled
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_are_broadcast_by_bytes_too(spark, monkeypatch):
    facts = skewed(spark)
    table = spark.range(0, 500, 2).select(F.col("id").alias("key"), F.repeat(F.lit("x"), 1000).alias("v"), F.array(F.lit("ab")).alias("w"))
    assert table.select(scale.row_bytes(table).alias("b")).first().b == 8 + 1000 + len('{"w":["ab"]}')
    whole = scale.lookup_join(facts, table, "key")
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 100_000)
    split = scale.lookup_join(facts, table, "key", absent=True)
    assert "Union" not in plan(whole) and "Union" in plan(split)
    assert sorted(map(tuple, whole.select("id", "key", "v").collect())) == sorted(map(tuple, split.select("id", "key", "v").collect()))


def test_sample_moves_keys_only(spark):
    """Two levels of buckets, and no exchange of the rows themselves."""
    rows = spark.range(3000).select(F.concat(F.col("id").cast("string"), F.lit(".xml")).alias("name"), F.repeat(F.lit("x"), 100).alias("text"))
    whole = scale.sample_rows(rows, "name", 1234, seed=3)
    deep = scale.sample_rows(rows, "name", 1234, seed=3, few=0)
    assert "Exchange" not in plan(whole)
    assert sorted(r.name for r in whole.collect()) == sorted(r.name for r in deep.collect()) and whole.count() == 1234
    assert scale.sample_rows(rows, "name", 0).count() == 0


def test_exact_quantiles_equal_percentile(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") * 7919 % 1013) / 8).alias("v"))
    quantiles = [0.0, 0.1, 0.5, 0.501, 0.77, 1.0]
    want = [rows.agg(F.percentile("v", q)).first()[0] for q in quantiles]
    got = scale.exact_quantiles(rows, "v", quantiles)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
    assert scale.exact_quantiles(rows.limit(0), "v", [0.5]) == [None]
