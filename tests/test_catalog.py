"""Registered queries against their SQL on the smallest tables. Set CATALOG=all for every query."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
import check
from pressloom import catalog

SF = "/root/testdata/sf0.001"
FAST = """publisher_alias dedup_text_md5 salience_score salience_quarterly label_counts_outer economic_ratio_year page_words
paragraphs tfidf_scores keyword_tagging_step upsert_keep three_label_step classification_report neardup_first_in_bucket
xml_record_columns export_chunks sample_articles incremental_stream replayed_run malformed_records paragraph_references chunk_file
append_chunks_twice publisher_page_size""".split()
NAMES = sorted(contract.queries()) if os.environ.get("CATALOG") == "all" else FAST

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    verdict, _ = check.compare(spark, con, name, SF)
    assert verdict.split()[0] in ("ok", "rows"), verdict


def test_every_oracle_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    # models that SQL cannot fit; tests of their own cover them
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set("economic_selection_step economic_train_report economic_train_score lda_top_words lda_topics".split())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["quarter", "normalized_sentiment", "normalized_adjusted_sentiment"] and df.count() > 0
