"""Line de-duplication by a log-template tree, in DataFrame operations only.

A line of ``min_tokens`` tokens or more (any line with a token, unless asked otherwise) belongs to a leaf of a fixed-depth tree: its number of tokens, then its
first ``depth`` tokens, where a token with a digit counts as a variable. In a leaf a token is constant at its place
if ``min_docs`` distinct lines' occurrences or more have it there, and a variable field otherwise; a line's template
is its constants with <*> for the rest, and it is a template at all only if constants fill ``min_constant`` of it.
A template found in ``min_docs`` documents or more recurs: the first line (least key, then least line number) of each of its wordings
stays, wordings being equal if they differ in digits only, and every other line of it is dropped. So a line whose fields
hold words found nowhere else is never dropped; without ``each_text`` only the first line of the template stays. Lines of
at most ``depth`` tokens share a leaf only if they are equal but for tokens with digits.

Only lines of leaves that reach ``min_docs`` are read further; equal lines of a leaf are one row with a count before
tokens are compared. All joins split hot keys off by their counts, so a line found in a third of all documents
meets nothing but a broadcast of that line.

Cases: null text stays null, and empty text or text without a line long enough stays as it is; rows that repeat get
the same decision, and copies count as documents of their own when their keys differ; a null key is a document like
any other; an empty table gives an empty result; extra columns are kept by ``clean``, also those named like working columns;
``n_lines`` and ``n_dropped`` of the input give way to the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.scale import lookup_join
from ..session import materialise, scratch

MIN_DOCS = 8
MIN_TOKENS = 1
DEPTH = 3
MIN_CONSTANT = 0.5
FIELD = "<*>"
SPACE = r"[\x20\x09-\x0D]+"


def _lines(docs: DataFrame, key: str, content: str, min_tokens: int, depth: int) -> DataFrame:
    """(_key, _text, _at, _tokens, _leaf) of every line long enough."""
    # tokens are made inside the generator, so that they are made once and not again for every use of the column
    parted = F.transform(F.split(content, "\n"), lambda line: F.filter(F.split(line, SPACE), lambda t: t != ""))
    tokens = docs.select(F.col(key).alias("_key"), F.xxhash64(content).alias("_text"), F.posexplode(parted).alias("_at", "_tokens"))
    lead = F.transform(F.slice("_tokens", 1, depth), lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))
    return tokens.filter(F.size("_tokens") >= min_tokens).withColumn("_leaf", F.xxhash64(F.size("_tokens"), lead))


def templates(docs: DataFrame, key: str = "doc_id", content: str = "text", min_docs: int = MIN_DOCS,
              min_tokens: int = MIN_TOKENS, depth: int = DEPTH, min_constant: float = MIN_CONSTANT, each_text: bool = True) -> DataFrame:
    """Every line that follows a recurring template: _key, _text (hash of the document), _at, _template, _first. With
    ``each_text`` lines that are alone in their wording are left out, and _template is the wording's."""
    lines = _lines(docs, key, content, min_tokens, depth)
    leaves = materialise(lines.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_docs), "leaves")
    held = lookup_join(lines, leaves, "_leaf", "_n").drop("_n").withColumn("_same", F.xxhash64("_leaf", "_tokens"))
    held = materialise(held, "lines")
    # distinct lines of a leaf, each with the number of its rows
    whole = materialise(held.groupBy("_same").agg(
        F.first("_leaf").alias("_leaf"), F.first("_tokens").alias("_tokens"), F.count(F.lit(1)).alias("_n")), "distinct-lines")
    wording = F.xxhash64(F.transform("_tokens", lambda t: F.regexp_replace(t, "[0-9]+", "0")))
    words = whole.select("_same", "_leaf", "_n", wording.alias("_wording"), F.size("_tokens").alias("_size"), F.posexplode("_tokens").alias("_place", "_token"))
    words = words.withColumn("_spot", F.xxhash64("_leaf", "_place", "_token"))
    constant = words.groupBy("_spot").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_rows")).filter(
        F.col("_all") >= min_docs).select("_spot", "_rows")
    kept = lookup_join(words, materialise(constant, "constants"), "_spot", "_rows")
    shape = kept.groupBy("_same").agg(
        F.first("_leaf").alias("_leaf"), F.first("_size").alias("_size"), F.first("_n").alias("_n"),
        F.first("_wording").alias("_wording"), F.array_sort(F.collect_list(F.struct("_place", "_token"))).alias("_fixed"))
    shape = materialise(shape.filter(F.size("_fixed") >= min_constant * F.col("_size")).select(
        "_same", "_n", F.xxhash64("_leaf", "_fixed").alias("_template"), *(["_wording"] if each_text else [])), "shapes")
    marked = materialise(lookup_join(held.select("_key", "_text", "_at", "_same"), shape, "_same", "_n").drop("_n", "_same"), "marked")
    # documents per template; a document's own repeats count once
    per_doc = marked.groupBy("_template", "_key", "_text").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_at"))
    recurring = per_doc.groupBy("_template").agg(
        F.count(F.lit(1)).alias("_docs"), F.sum("_rows").alias("_rows"),
        F.min(F.struct(F.col("_key").isNull().alias("_none"), "_key", "_text", "_at")).alias("_head"),
    ).filter(F.col("_docs") >= min_docs).drop("_docs")
    recurring = materialise(recurring, "recurring")
    if each_text:
        marked = lookup_join(marked, recurring.drop("_head"), "_template", "_rows").drop("_rows")
        marked = marked.withColumn("_template", F.xxhash64("_template", "_wording")).drop("_wording")
        recurring = materialise(marked.groupBy("_template").agg(
            F.count(F.lit(1)).alias("_rows"),
            F.min(F.struct(F.col("_key").isNull().alias("_none"), "_key", "_text", "_at")).alias("_head"),
        ).filter("_rows > 1"), "wordings")
    found = lookup_join(marked, recurring, "_template", "_rows")
    first = (F.col("_key").eqNullSafe(F.col("_head._key")) & (F.col("_text") == F.col("_head._text"))
             & (F.col("_at") == F.col("_head._at")))
    return found.withColumn("_first", first).drop("_head", "_rows")


def dropped_lines(docs: DataFrame, key: str = "doc_id", content: str = "text", **options) -> DataFrame:
    """(_key, _text, _drop): positions of the lines to drop, one row per document that has any."""
    found = templates(docs, key, content, **options).filter(~F.col("_first"))
    return found.groupBy("_key", "_text").agg(F.collect_set("_at").alias("_drop"))


def clean(docs: DataFrame, key: str = "doc_id", content: str = "text", counts: bool = True, drop_emptied: bool = False,
          **options) -> DataFrame:
    """``docs`` with the dropped lines gone; with ``counts`` also n_lines and n_dropped. With ``drop_emptied`` a document
    goes when lines of it were dropped and nothing but white space is left: all it says stands in other documents."""
    with scratch(docs.sparkSession):
        drop = materialise(dropped_lines(docs, key, content, **options), "drop", keep=True)
    met = docs.join(drop, docs[key].eqNullSafe(drop["_key"]) & (F.xxhash64(docs[content]) == drop["_text"]), "left")
    lines = F.split(docs[content], "\n")
    gone = drop["_drop"]
    rest = F.filter(lines, lambda line, at: ~F.array_contains(gone, at))
    text = F.when(gone.isNull(), docs[content]).otherwise(F.array_join(rest, "\n"))
    if drop_emptied:
        met = met.filter(gone.isNull() | (F.regexp_replace(text, SPACE, "") != ""))
    replaced = ("n_lines", "n_dropped") if counts else ()
    columns = [text.alias(content) if c == content else docs[c] for c in docs.columns if c not in replaced]
    if counts:
        columns += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped")]
    return met.select(*columns)
