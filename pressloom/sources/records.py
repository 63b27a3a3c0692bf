"""Article records (XML) as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import labels, text
from ..schema import ARTICLE_SCHEMA, PROPERTY_NAMES, PROPERTY_TAGS, RECORD_SCHEMA

CORRUPT = "_corrupt"
READ_SCHEMA = T.StructType([*RECORD_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
READ_OPTIONS = {"rowTag": "RECORD", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}

# Characters XML 1.0 does not allow.
ILLEGAL_XML = r"[^\t\n\r\u0020-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]"


def file_columns(path: Column) -> tuple[Column, Column]:
    """(corpus, name) from a file path: its last two parts; a folder ``corpus=x`` is corpus x."""
    parts = F.split(F.regexp_replace(path, r"[?#].*$", ""), "/")
    return F.regexp_replace(F.element_at(parts, -2), "^corpus=", ""), F.element_at(parts, -1)


def list_files(spark: SparkSession, folder: str, glob: str = "*.xml") -> DataFrame:
    """(path, corpus, name) of files below a folder; contents are not read. Spark's readers leave out files of no bytes."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .load(folder).select("path")
    )
    corpus, name = file_columns(F.col("path"))
    return files.select("path", corpus.alias("corpus"), name.alias("name"))


def read_records(spark: SparkSession, folder: str, glob: str = "*.xml") -> DataFrame:
    """Nested records with ``corpus`` and ``name``; files without a record give no row.

    A record that is no XML is one row with its text in ``_corrupt``. What follows it in its file cannot be told apart
    and is part of that text.
    """
    corpus, name = file_columns(F.col("_metadata.file_path"))
    return (
        spark.read.format("xml").options(**READ_OPTIONS).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).schema(READ_SCHEMA).load(folder)
        .select("*", corpus.alias("corpus"), name.alias("name"))
    )


def parse_records(df: DataFrame, xml: str) -> DataFrame:
    """Nested records from a column of XML text; ``_corrupt`` holds a text that is no XML.

    A filter on a parsed column would be pushed below the parse, with a second parse of its own.
    """
    parsed = F.explode(F.array(F.from_xml(F.col(xml), READ_SCHEMA, READ_OPTIONS))).alias("_r")
    keep = [c for c in df.columns if c != xml]
    return df.select(*keep, parsed).select(*keep, "_r.*")


def article_columns(paragraph_sep: str | None = None) -> list[Column]:
    """The 13 article columns of a nested record; absent tags are null."""
    def clean(value: Column) -> Column:
        return F.nullif(text.strip(value), F.lit(""))

    def first(values: Column) -> Column:
        return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))

    body = text.article_paragraphs(F.col("TextInfo.Text._VALUE"))
    terms = F.col("Obj.Terms.Term")
    values = {
        "goid": clean(F.col("GOID")),
        "publisher": clean(F.lower(first(F.col("DFS.PubFrosting.SortTitle")))),
        "date": labels.iso_date(clean(F.col("Obj.NumericDate"))),
        "article_type": clean(first(F.col("Obj.ObjectTypes.mstar"))),
        "section": clean(F.col("Obj.PrintLocation.DocSection")),
        "tdm_topic_tags": clean(F.get(F.col("Obj.Terms.GenSubjTerm.GenSubjValue"), F.lit(0))),
        "page": clean(F.col("Obj.PrintLocation.StartPage")),
        "word_count": F.col("TextInfo.Text._WordCount").try_cast("int"),
        "title": clean(first(F.col("Obj.TitleAtt.Title"))),
        "paragraph_text": body if paragraph_sep is None else text.full_text(body, paragraph_sep),
        "company_name": clean(first(F.transform(terms, lambda t: t["CompanyName"]))),
        "author": clean(first(F.transform(terms, lambda t: t["Personal"]))),
        "lexile_score": clean(F.col("Obj.LexileScore")).try_cast("int"),
    }
    return [values[name].alias(name) for name in PROPERTY_NAMES]


def all_topic_tags() -> Column:
    """Every subject term of a record, not only the first."""
    return F.filter(F.transform("Obj.Terms.GenSubjTerm", lambda t: text.strip(t["GenSubjValue"])), lambda v: v.isNotNull())


def tag_columns(tags: Sequence[str]) -> list[Column]:
    """Enrichment tags as string columns; ``tf_idf`` as its list of words."""
    def value(tag: str) -> Column:
        raw = F.try_element_at(F.col("processed"), F.lit(tag))
        return F.when(raw.isNotNull(), text.keyword_terms(raw)) if tag == "tf_idf" else text.strip(raw)
    return [value(t).alias(t) for t in tags]


def articles(records: DataFrame, tags: Sequence[str] = (), paragraph_sep: str | None = None) -> DataFrame:
    """Flat article rows with the fixed columns, then the extra tags, in that order; malformed records are no articles."""
    keep = [c for c in ("corpus", "name") if c in records.columns]
    whole = records.filter(F.col(CORRUPT).isNull()) if CORRUPT in records.columns else records
    return whole.select(*keep, *article_columns(paragraph_sep), *tag_columns(tags))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(corpus, name, xml): whole files, unparsed."""
    corpus, name = file_columns(F.col("_metadata.file_path"))
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml")
        .text(folder, wholetext=True)
    )
    return files.select(corpus.alias("corpus"), name.alias("name"), F.col("value").alias("xml"))


def load(spark: SparkSession, folder: str, manifest: DataFrame | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Articles named in a manifest of (corpus, name) (all without one). Only files of the manifest are parsed.

    A manifest without a corpus takes its names from every corpus. A file is a record's; ``sources.store`` has the form
    for many loads from one corpus, which reads listed parts only and takes files of many records.
    """
    if manifest is None:
        return articles(read_records(spark, folder), tags)
    keys = [k for k in ("corpus", "name") if k in manifest.columns]
    wanted = read_texts(spark, folder).join(manifest.select(*keys).distinct(), keys, "left_semi")
    has_record = F.contains("xml", F.lit("<RECORD"))
    return articles(parse_records(wanted.filter(has_record), "xml"), tags)


def load_from_text(df: DataFrame, xml: str, tags: Sequence[str] = ()) -> DataFrame:
    return articles(parse_records(df, xml), tags)


def expected_columns(df: DataFrame, tags: Sequence[str] = ()) -> DataFrame:
    """The fixed columns and tags in order; absent ones as nulls."""
    types = {f.name: f.dataType for f in ARTICLE_SCHEMA}
    return df.select(*[
        F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, T.StringType())).alias(c)
        for c in (*PROPERTY_NAMES, *tags)
    ])


def load_errors(spark: SparkSession, folder: str) -> DataFrame:
    """(corpus, name, error): files without a record, malformed records, and records without a text."""
    bare, broken = F.col("TextInfo.Text").isNull(), F.col(CORRUPT).isNotNull()
    error = F.when(broken, "malformed").when(bare, "no text")
    found = read_records(spark, folder).select("corpus", "name", error.alias("error"))
    empty = list_files(spark, folder).join(found, ["corpus", "name"], "left_anti").select(
        "corpus", "name", F.lit("no record").alias("error"))
    return empty.unionByName(found.filter("error IS NOT NULL"))


def malformed(records: DataFrame) -> DataFrame:
    """(corpus, name, goid, xml) of records that are no XML, for a quarantine table; the goid is what was read before the fault."""
    keep = [c for c in ("corpus", "name") if c in records.columns]
    return records.filter(F.col(CORRUPT).isNotNull()).select(*keep, F.col("GOID").alias("goid"), F.col(CORRUPT).alias("xml"))


def tag_value(xml: Column, tag: str) -> Column:
    """Text of the first element of a name at any depth; null when there is none."""
    found = F.xpath_boolean(xml, F.lit(f"boolean(//{tag})"))
    return F.when(found, text.strip(F.xpath_string(xml, F.lit(f"(//{tag})[1]"))))


def legal(value: Column) -> Column:
    """Text without the characters XML cannot hold."""
    return F.regexp_replace(value, ILLEGAL_XML, "")


def paragraphs_html(paragraphs: Column) -> Column:
    """Paragraphs as the HTML body a record's Text element holds."""
    def entities(p: Column) -> Column:
        return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])),
                      (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), legal(p))
    body = F.array_join(F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), entities(p), F.lit("</p>"))), "")
    return F.concat(F.lit("<html><body>"), body, F.lit("</body></html>"))


def to_records(articles_df: DataFrame, tags: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Article rows as nested records, ``tags`` below ``processed``; null columns give no element. ``keep`` are columns to
    place the records by."""
    def text_of(column: str) -> Column:
        return legal(F.col(column).cast("string"))

    def some(column: str, struct: Column) -> Column:
        return F.when(F.col(column).isNotNull(), struct)

    filled = F.coalesce("paragraph_text", F.array().cast("array<string>"))
    body = F.struct(paragraphs_html(filled).alias("_VALUE"), F.col("word_count").cast("string").alias("_WordCount"))
    shown = F.map_filter(F.create_map(*[c for t in tags for c in (F.lit(t), text_of(t))]), lambda _, v: v.isNotNull()) \
        if tags else F.create_map().cast("map<string,string>")
    term = F.struct(text_of("author").alias("Personal"), text_of("company_name").alias("CompanyName"))
    return articles_df.select(
        text_of("goid").alias("GOID"),
        F.struct(
            some("article_type", F.struct(F.array(text_of("article_type")).alias("mstar"))).alias("ObjectTypes"),
            some("title", F.struct(F.array(text_of("title")).alias("Title"))).alias("TitleAtt"),
            text_of("date").alias("NumericDate"),
            F.struct(text_of("page").alias("StartPage"), text_of("section").alias("DocSection")).alias("PrintLocation"),
            text_of("lexile_score").alias("LexileScore"),
            F.struct(
                some("tdm_topic_tags", F.array(F.struct(text_of("tdm_topic_tags").alias("GenSubjValue")))).alias("GenSubjTerm"),
                F.when(F.coalesce("author", "company_name").isNotNull(), F.array(term)).alias("Term"),
            ).alias("Terms"),
        ).alias("Obj"),
        F.when(F.col("paragraph_text").isNotNull() | F.col("word_count").isNotNull(), F.struct(body.alias("Text"))).alias("TextInfo"),
        some("publisher", F.struct(F.struct(F.array(text_of("publisher")).alias("SortTitle")).alias("PubFrosting"))).alias("DFS"),
        shown.alias("processed"),
        *keep,
    )


def record_xml(records: DataFrame) -> DataFrame:
    """(goid, xml): each nested record printed as one RECORD text, once, whatever filter follows."""
    printed = F.to_xml(F.struct(*records.columns), {"rowTag": "RECORD"})
    return records.select(F.col("GOID").alias("goid"), F.explode(F.array(printed)).alias("xml"))


def write_records(articles_df: DataFrame, path: str, tags: Sequence[str] = ()) -> None:
    """Articles as XML files of many records each; the commit protocol makes the write atomic."""
    to_records(articles_df, tags).write.format("xml").option("rootTag", "RECORDS").option("rowTag", "RECORD").save(path)


__all__ = ["PROPERTY_TAGS", "articles", "expected_columns", "file_columns", "list_files", "load", "load_errors",
           "load_from_text", "malformed", "parse_records", "read_records", "read_texts", "record_xml", "tag_value", "to_records", "write_records"]
