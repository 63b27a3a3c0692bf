"""From raw documents to packed training sequences, in five stages over written tables.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns the columns of
``documents``; the last returns packed pieces.

1. quality: documents that the line-level quality classifier rejects go.
2. line_dedup: lines of recurring templates go, short lines too, but for the first of each wording (digits apart);
   documents left without text go too.
3. near_dup: of documents linked by 80 % of their five-word shingles the one of least doc_id stays.
4. decontaminate: documents that hold a passage of a benchmark item go.
5. packing: what is left becomes sequences of at most 4096 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressloom.llm import decontaminate, line_templates, packing, parity_join, quality
from pressloom.session import materialise

#: SQL can state neither the trained classifier nor the tokenizer. tests/llm/test_pipeline.py checks the quality stage by its labels and
#: the order and columns of the stages, but holds line_dedup, near_dup and decontaminate against no plain version on the tables.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_templates.clean(docs, counts=False, drop_emptied=True, min_tokens=1, each_text=True)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.keep_one(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("near_dup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
