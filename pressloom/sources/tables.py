"""Manifests, CSV folders, lookups and their writers."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import text
from ..operators.clean import distinct_by_text, union_all
from ..operators.scale import global_rank, sample_rows
from ..schema import CSV_TEXT_COLUMN, EXPORT_COLUMNS, PAGE_SIZES, PUBLISHER_ALIASES
from ..streaming import commits
from .records import list_files

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a list file: stripped, blank lines skipped."""
    return spark.read.text(path).select(text.strip(F.col("value")).alias("name")).filter(F.col("name") != "")


def numbered_chunks(lines: DataFrame, size: int, order: Sequence[str], name: str = "name") -> DataFrame:
    """(name, chunk): chunk number by line position, blank lines counted but left out."""
    ranked = global_rank(lines, *[F.col(c) for c in order], name="_line")
    return (
        ranked.withColumn(name, text.strip(F.col(name)))
        .withColumn("chunk", F.floor((F.col("_line") - 1) / size).cast("long"))
        .filter(F.col(name) != "").drop("_line")
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line of text files with its number in its file, from 1, blank lines counted.

    A large file is read in splits. Lines stand in order within a split, so a count per split places them all: two
    passes, no sort, and a join with one row per split.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.partitionBy("file").orderBy("_block")) - F.col("_n")
    offsets = splits.select("file", "_block", "_first", before.alias("_before"))
    return lines.join(F.broadcast(offsets), ["file", "_block"]).select(
        "file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), "value")


def chunks_of_file(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(file, chunk, name): names of list files in chunks of ``size`` lines; blank lines count and are left out."""
    named = numbered_lines(spark, path).withColumn("name", text.strip(F.col("value")))
    return named.filter(F.col("name") != "").select("file", F.floor((F.col("line") - 1) / size).cast("long").alias("chunk"), "name")


def sample_files(spark: SparkSession, folder: str, size: int, seed: int = 0) -> DataFrame:
    """(path) ``corpus/name`` of min(size, files) files, repeatable; an empty folder is an error."""
    files = list_files(spark, folder).select(F.concat_ws("/", "corpus", "name").alias("path"))
    if files.isEmpty():
        raise ValueError(f"no XML files below {folder}")
    return sample_rows(files, "path", size, seed)


def read_csv_folder(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All CSV files of a folder that share one header; an empty folder gives an empty table."""
    try:
        return spark.read.options(**CSV_OPTIONS).option("pathGlobFilter", "*.csv").schema(schema).csv(folder)
    except Exception as e:  # a folder that does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_csv_folders(spark: SparkSession, folders: dict[str, T.StructType | str]) -> DataFrame:
    """Folders with different headers as one table, ``{folder: schema}``."""
    return union_all([read_csv_folder(spark, f, s) for f, s in folders.items()])


def chunk_number(file_name: Column) -> Column:
    """The integer in ``chunk_12_data.csv``."""
    return F.get(F.split(file_name, "_"), F.lit(1)).try_cast("int")


def list_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(name, number) of chunk files, ordered by number."""
    files = list_files(spark, folder, "*.csv").select("name", chunk_number(F.col("name")).alias("number"))
    return files.orderBy("number", "name")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a word list."""
    return read_names(spark, path).select(F.col("name").alias("word")).distinct()


def read_lemmas(spark: SparkSession, path: str) -> DataFrame:
    """(term, lemma) of lines ``inflected lemma ...``; the first lemma counts."""
    parts = F.split(F.col("name"), r"\s+")
    rows = read_names(spark, path).select(parts[0].alias("term"), F.get(parts, F.lit(1)).alias("lemma"))
    return rows.filter(F.col("lemma").isNotNull()).groupBy("term").agg(F.min("lemma").alias("lemma"))


def publisher_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PUBLISHER_ALIASES.items()), "src string, dst string")


def page_sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PAGE_SIZES.items()), "publisher string, page_size int")


def with_text(results: DataFrame, articles: DataFrame, key: str = "goid") -> DataFrame:
    """Result rows with their article's text, by one join instead of a read per row. Of articles that repeat a key the
    least text counts, so no result row is multiplied."""
    texts = articles.groupBy(F.col(key).cast("string").alias("_key")).agg(F.min("paragraph_text").alias("texts"))
    return results.join(texts, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")


def find_article(articles: DataFrame, corpus: str, goid: str | int) -> DataFrame:
    """One article; both filters reach a corpus-partitioned scan."""
    return articles.filter((F.col("corpus") == corpus) & (F.col("goid") == str(goid)))


def printed(df: DataFrame) -> DataFrame:
    """Columns as a CSV can hold them: keyword structs as tag text, other arrays as JSON."""
    def column(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if field.dataType.simpleString() == "array<struct<term:string,score:double>>":
            c = text.keyword_literal(c)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        return c.alias(CSV_TEXT_COLUMN if field.name == "paragraph_text" else field.name)
    return df.select(*[column(f) for f in df.schema])


def write_chunks(df: DataFrame, folder: str, rows: int = 2000) -> None:
    """Append CSV files of at most ``rows`` rows; no ordering, so no shuffle."""
    printed(df).write.mode("append").options(**CSV_OPTIONS).option("maxRecordsPerFile", rows).csv(folder)


def with_chunks(df: DataFrame, order: Sequence[str], rows: int = 2000, highest: int = -1) -> DataFrame:
    """Number rows into chunks that continue after the highest existing one."""
    ranked = global_rank(df, *[F.col(c) for c in order], name="_rn")
    return ranked.withColumn("chunk", (F.floor((F.col("_rn") - 1) / rows) + 1 + highest).cast("long")).drop("_rn")


def write_distinct(df: DataFrame, path: str, content: str = "text", order: Sequence[str] = ("date", "goid")) -> None:
    """One row per text, the earliest, with its text and ``text_hash``, as a CSV folder that is there whole or not at all.
    Only one row per text and task goes through the shuffle."""
    joined = F.array_join(content, " ") if isinstance(df.schema[content].dataType, T.ArrayType) else F.col(content)
    rows = distinct_by_text(df, joined, order).withColumn("text_hash", F.md5(joined))
    printed(rows).write.options(**CSV_OPTIONS).csv(path)


def reserve_chunks(spark: SparkSession, folder: str, count: int, wait: float = 10.0) -> int:
    """First of ``count`` chunk numbers that are this caller's alone, after all that are written or reserved.

    A range is claimed by creating ``_reserved/<first number>``, which one writer only can do; the file says how many
    numbers go with it. Two writers never share a number; the numbers of a writer that failed stay unused.
    """
    held = f"{folder}/_reserved"
    written = [int(n.removeprefix("chunk=")) + 1 for n in commits.children(spark, folder) if n.removeprefix("chunk=").isdigit()]
    until = time.monotonic() + wait
    while True:
        lengths = {name: commits.text_of(spark, f"{held}/{name}") for name in commits.children(spark, held)}
        unsaid = [name for name, length in lengths.items() if not length]
        if not unsaid:
            first = max([0, *written, *[int(name) + int(length) for name, length in lengths.items()]])
            if commits.claim(spark, f"{held}/{first:012d}", str(count)):
                return first
        elif time.monotonic() > until:  # a writer takes a moment from making its file to writing it
            raise RuntimeError(f"{held}/{unsaid[0]} reserves no numbers; delete it if its writer is gone")
        time.sleep(0.05)


def append_chunks(df: DataFrame, folder: str, order: Sequence[str], rows: int = 2000) -> tuple[int, int]:
    """Append ``chunk=<n>`` folders whose numbers continue after those already in the folder, beside other writers too.

    Returns the first number and how many there are.
    """
    ranked = global_rank(df, *[F.col(c) for c in order], name="_rn")
    number = -(-(ranked.agg(F.max("_rn")).first()[0] or 0) // rows)
    if not number:
        return 0, 0
    first = reserve_chunks(df.sparkSession, folder, number)
    placed = ranked.withColumn("chunk", (F.floor((F.col("_rn") - 1) / rows) + first).cast("long")).drop("_rn")
    printed(placed).write.mode("append").options(**CSV_OPTIONS).partitionBy("chunk").csv(folder)
    return first, number


def read_chunks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of ``chunk=<n>`` folders, with their number."""
    return spark.read.options(**CSV_OPTIONS).schema(f"{schema}, chunk bigint").csv(folder)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def export(df: DataFrame) -> DataFrame:
    """The text-free export columns; a missing column is an error."""
    return df.select(*EXPORT_COLUMNS)


def write_names(df: DataFrame, path: str, column: str = "name") -> None:
    """Append a list, one value per line."""
    df.select(F.col(column).alias("value")).write.mode("append").text(path)


def tag_lines(counts: DataFrame, per_line: int = 6, tag: str = "tag", count: str = "count") -> DataFrame:
    """(line, value): tags by falling frequency, comma-joined, ``per_line`` each."""
    ranked = global_rank(counts, F.desc(count), F.col(tag), name="_rn")
    lines = ranked.groupBy(F.floor((F.col("_rn") - 1) / per_line).cast("long").alias("line")).agg(
        F.sort_array(F.collect_list(F.struct("_rn", tag))).alias("_t"))
    return lines.select("line", F.array_join(F.transform("_t", lambda t: t[tag]), ", ").alias("value"))


def article_paths(df: DataFrame, corpus: Column, goid: str = "goid") -> DataFrame:
    """(value) ``corpus/goid.xml``."""
    return df.select(F.concat(corpus, F.lit("/"), F.col(goid).cast("string"), F.lit(".xml")).alias("value"))


def page_size_json(stats: DataFrame) -> DataFrame:
    """(value) one JSON object per page."""
    return stats.select(F.to_json(F.struct("page", "mean_words", "count")).alias("value"))
