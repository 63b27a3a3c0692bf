"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] (default all cores). Each
query is run to a full result (every column computed) by a write to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pressloom.catalog import QUERIES
from pressloom.session import build_session

HEADLINE = (
    "salience_quarterly", "sentiment_zscore", "label_counts_one_pass", "economic_ratio_year_publisher",
    "page_stats", "dedup_key", "dedup_text_md5", "paragraphs", "paragraph_wordcount", "clean_text",
    "tfidf_idf", "tfidf_keywords_200", "tfidf_vocab1000_scores", "economic_probability",
    "paragraph_sentiment_avg", "three_label_step", "minhash_signature", "neardup_first_in_bucket",
    "neardup_greedy", "count_matrix_df_bounds", "xml_record_columns", "csv_to_record_merge",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    partitions = str(os.cpu_count() if cpus == "*" else int(cpus))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=partitions, spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="pressloom-bench-"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
