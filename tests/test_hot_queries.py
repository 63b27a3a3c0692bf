"""Queries whose fact keys are hot, with tables far too long to broadcast: the same rows as with small ones."""

import os

import pytest

from pressloom.catalog import QUERIES
from pressloom.operators import scale

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["count_matrix_df_bounds", "lemma_lookup", "lexicon_sentiment", "neardup_greedy", "neardup_verified"])
def test_rows_do_not_depend_on_the_way_of_the_join(spark, monkeypatch, name):
    small = sorted(map(repr, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(repr, QUERIES[name](spark, SF).collect())) == small and small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
