"""The registered queries of this subpackage, each over its whole table, with SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (alignment, codes, cuckoo, decontaminate, html_text, language, licenses, line_templates, packing, parity_join, passages, quality,
               token_counts)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.dedup(table(spark, sf_dir, "documents"))


@query("op6_parity_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.link(table(spark, sf_dir, "documents"), k=3, percent=90)


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LINES_SQL = r"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
 FROM documents),
tokened AS (SELECT doc_id, pos, list_filter(string_split(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda t: t <> '') AS tokens FROM split),
leaved AS (SELECT *, list_transform(tokens[1:3], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS lead
 FROM tokened WHERE len(tokens) >= 1),
leaves AS (SELECT len(tokens) AS size, lead FROM leaved GROUP BY ALL HAVING count(*) >= 8),
held AS (SELECT l.doc_id, l.pos, l.tokens, l.lead FROM leaved l JOIN leaves v ON len(l.tokens) = v.size AND l.lead = v.lead),
words AS (SELECT doc_id, pos, lead, list_transform(tokens, lambda t: regexp_replace(t, '[0-9]+', '0', 'g')) AS wording, len(tokens) AS size, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM held),
constants AS (SELECT lead, size, place, token FROM words GROUP BY ALL HAVING count(*) >= 8),
marked AS (SELECT doc_id, pos, lead, size, wording, list({'p': place, 't': token} ORDER BY place) AS fixed
 FROM words JOIN constants USING (lead, size, place, token) GROUP BY doc_id, pos, lead, size, wording HAVING count(*) >= 0.5 * size),
recurring AS (SELECT lead, size, fixed FROM marked GROUP BY lead, size, fixed HAVING count(DISTINCT doc_id) >= 8),
worded AS (SELECT m.*, min({'d': doc_id, 'a': pos}) OVER (PARTITION BY lead, size, fixed, wording) AS head
 FROM marked m JOIN recurring USING (lead, size, fixed)),
gone AS (SELECT doc_id, list(pos) AS ats FROM worded WHERE {'d': doc_id, 'a': pos} <> head GROUP BY doc_id)
SELECT doc_id, CASE WHEN ats IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(
 list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))), lambda z: NOT list_contains(ats, z[2])), lambda z: z[1]), chr(10)), '') END AS text,
 len(string_split(text, chr(10))) AS n_lines, coalesce(len(ats), 0) AS n_dropped
FROM documents LEFT JOIN gone USING (doc_id)"""


@query("op3_line_templates", LINES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


@query("op8_passages")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(table(spark, sf_dir, "documents"))


def derived_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document, placed by hash: a deletion, an insertion and a replacement."""
    def at(i: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(i)), F.length(F.coalesce("text", F.lit(""))) + 1)

    def edit(i: int, remove: int, insert):
        return F.struct(F.lit(i).alias("seq"), at(i).alias("at"), F.lit(remove).alias("remove"), insert.alias("insert"))

    label = F.concat_ws(" ", F.lit(" from"), "source", "lang")
    edits = F.array(edit(0, 12, F.lit("")), edit(1, 0, label), edit(2, 20, F.concat(label, F.lit("\n"))))
    return docs.select("doc_id", F.inline(edits))


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_counts.count(docs, derived_edits(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op11_licenses")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def codes_sql(rounds: int = codes.ROUNDS, entries: int = codes.ENTRIES, parts: int = codes.PARTS) -> str:
    """The rounds spelled out; distances by inner products of whole numbers, which doubles hold exactly."""
    steps = [f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[len(v) // {parts} * part + 1 : len(v) // {parts} * (part + 1)] AS v FROM k, range({parts}) r(part)),
c0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, v FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS rn FROM p) WHERE rn <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, min({{'d': d, 'e': entry}}) AS m, any_value(v) AS v FROM (
 SELECT p.vec_id, p.part, p.v, entry, (list_inner_product(p.v, p.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(p.v, c.v))::BIGINT AS d
 FROM p JOIN c{r} c ON p.part = c.part) GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""n{r} AS (SELECT part, entry, list(x ORDER BY place) AS v FROM (SELECT part, m.e AS entry, place, floor(sum(x)::BIGINT / count(*)) AS x
 FROM (SELECT part, m, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r}) GROUP BY ALL) GROUP BY part, entry),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n ON c.part = n.part AND c.entry = n.entry)""")
    last = f"""h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
 FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM c{rounds})),
g AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM g JOIN k USING (vec_id), h"""
    return ",\n".join([*steps, last])


@query("op12_vector_codes", codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))
