"""Paragraphs, cleaning, tokens and TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import clean, tfidf
from ..plans import steps
from ..schema import STOP_WORDS
from ..session import shared_path, spread
from .base import ARTICLES, TITLED, articles, clean_sql, documents, query, quoted, strip_sql, table, titled, tokens_sql, valid_sql

STOP = quoted(STOP_WORDS)
# References that the pages hold; the ampersand comes last. ``paragraph_references`` has others.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&amp;", "&"))


def _inner(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, char in ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return strip_sql(out)


HTML_SQL = (
    f"list_transform(string_split_regex(regexp_replace(html, '{text.HIDDEN_HTML}', '', 'g'), '{text.PARAGRAPH_OPEN}')[2:], "
    f"lambda piece: {_inner(f'''regexp_extract(piece, '{text.PARAGRAPH_BODY}', 1)''')})"
)
PS = f"ps AS (SELECT page_id, {HTML_SQL} AS raw FROM pages), kept AS (SELECT page_id, raw, {valid_sql('raw')} AS ps FROM ps)"


def pages(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "html"))


@query("paragraphs", f"WITH {PS}, e AS (SELECT page_id, unnest(ps) AS paragraph, generate_subscripts(ps, 1) - 1 AS pos FROM kept) "
       "SELECT page_id, CAST(pos AS INT) AS pos, paragraph FROM e")
def paragraphs(spark, sf):
    return pages(spark, sf).select("page_id", F.posexplode(text.article_paragraphs(F.col("html"))).alias("pos", "paragraph"))


# Written forms of characters: decimal, hexadecimal with leading zeros, and named; names after the letters they are spelt with.
_WRITTEN = (("&", "&#38;"), ("e", "&#101;"), ("n", "&#x6E;"), ("o", "&#X0006f;"), ("a", "&#0097;"), ("ñ", "&#241;"), ("<", "&lt;"), (">", "&gt;"),
            ("'", "&apos;"), ('"', "&quot;"), ("é", "&eacute;"), ("ü", "&uuml;"), ("ß", "&szlig;"), (".", "&period;"), (",", "&comma;"))


@query("paragraph_references", f"""WITH {TITLED}, e AS (SELECT goid, unnest(paragraph_text) AS paragraph,
 generate_subscripts(paragraph_text, 1) - 1 AS pos FROM titled) SELECT goid, CAST(pos AS INT) AS pos, paragraph FROM e""")
def paragraph_references(spark, sf):
    """The documents' lines as paragraphs of a page that writes many characters as references."""
    html = F.col("text")
    for char, written in _WRITTEN:
        html = F.replace(html, F.lit(char), F.lit(written))
    page = F.concat(F.lit("<html><body><p>"), F.replace(html, F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p></body></html>"))
    rows = articles(spark, sf).select("goid", page.alias("html"))
    return rows.select("goid", F.posexplode(text.article_paragraphs(F.col("html"))).alias("pos", "paragraph"))


@query("full_text", f"WITH {PS} SELECT page_id, CASE WHEN len(ps) > 0 THEN array_to_string(ps, ' ') END AS text FROM kept")
def full_text(spark, sf):
    return pages(spark, sf).select("page_id", text.full_text(text.article_paragraphs(F.col("html"))).alias("text"))


@query("full_text_glued", f"WITH {PS} SELECT page_id, CASE WHEN len(ps) > 0 THEN array_to_string(ps, '') END AS text FROM kept")
def full_text_glued(spark, sf):
    return pages(spark, sf).select("page_id", text.full_text(text.article_paragraphs(F.col("html")), "").alias("text"))


@query("paragraph_wordcount", rf"WITH {PS} SELECT page_id, nullif(CAST(list_sum(list_transform(raw, lambda p: len(regexp_extract_all(p, '\S+')))) AS INT), 0) AS words FROM kept")
def paragraph_wordcount(spark, sf):
    return pages(spark, sf).select("page_id", text.paragraph_word_count(text.html_paragraphs(F.col("html"))).alias("words"))


@query("clean_text", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return spread(documents(spark, sf).select("doc_id", "text")).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("topic_tokens", rf"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(text), '[!-/:-@\[-`{{-~0-9]', '', 'g'), '\S+'),
 lambda w: w NOT IN ({STOP})), ' ') AS processed FROM documents""")
def topic_tokens(spark, sf):
    docs = spread(documents(spark, sf).select("doc_id", "text"))
    return docs.select("doc_id", F.array_join(text.topic_tokens(F.col("text")), " ").alias("processed"))


@query("topic_list_tokens", rf"""WITH {TITLED} SELECT goid, array_to_string(list_filter(regexp_extract_all(lower(array_to_string(paragraph_text, ' ')), '\S+'),
 lambda w: regexp_matches(w, '^\p{{L}}+$') AND w NOT IN ({STOP})), ' ') AS processed FROM titled WHERE paragraph_text IS NOT NULL""")
def topic_list_tokens(spark, sf):
    words = F.array_join(text.topic_list_tokens(F.col("paragraph_text")), " ")
    return clean.with_required(titled(spark, sf), "processed", words).select("goid", "processed")


@query("title_body_doc", f"WITH {TITLED} SELECT goid, concat(title, ' ', array_to_string(paragraph_text, ' ')) AS doc FROM titled WHERE paragraph_text IS NOT NULL AND title IS NOT NULL")
def title_body_doc(spark, sf):
    return titled(spark, sf).transform(steps.document()).select("goid", "doc")


@query("title_body_skipped", f"WITH {TITLED} SELECT count(*) FILTER (paragraph_text IS NULL OR title IS NULL) AS skipped FROM titled")
def title_body_skipped(spark, sf):
    doc = text.title_and_body(F.col("title"), F.col("paragraph_text"))
    return titled(spark, sf).agg(F.count_if(doc.isNull()).alias("skipped"))


@query("keyword_literal_parse", f"""WITH t AS (SELECT doc_id, list_distinct({tokens_sql('text')}) AS ts FROM documents)
 SELECT doc_id, array_to_string(list_sort(ts), ' ') AS terms FROM t""")
def keyword_literal_parse(spark, sf):
    """Tokens of each document printed as a keyword tag, then parsed back."""
    terms = F.array_sort(F.array_distinct(text.tokens(F.col("text"))))
    keywords = F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(0.25).alias("score")))
    printed = spread(documents(spark, sf).select("doc_id", "text")).select("doc_id", text.keyword_literal(keywords).alias("tag"))
    return printed.select("doc_id", F.array_join(text.keyword_terms(F.col("tag")), " ").alias("terms"))


@query("parse_list", f"""WITH {ARTICLES} SELECT goid, CASE WHEN goid % 3 = 0 THEN text ELSE array_to_string([lang, tag], '|') END AS joined,
 CAST(CASE WHEN goid % 3 = 0 THEN 1 ELSE 2 END AS INT) AS elements FROM articles""")
def parse_list(spark, sf):
    """Single-quoted list texts, and plain texts that stay one element."""
    shown = F.when(F.col("goid") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("['"), F.col("lang"), F.lit("', '"), F.col("tag"), F.lit("']")))
    parsed = text.parse_list(shown)
    return articles(spark, sf).select("goid", F.array_join(parsed, "|").alias("joined"), F.size(parsed).alias("elements"))


# --- TF-IDF ----------------------------------------------------------------------------------

TOKENS = f"""tok AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents),
 w AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term NOT IN ({STOP}) GROUP BY doc_id, term),
 df AS (SELECT term, count(*) AS df, sum(tf) AS tf FROM w GROUP BY term)"""
IDF = "ln((1.0E0 + (SELECT count(*) FROM documents)) / (1.0E0 + df)) + 1.0E0"


def scores_sql(vocabulary: str = "df") -> str:
    return f"""r AS (SELECT w.doc_id, w.term, w.tf * ({IDF}) AS raw FROM w JOIN {vocabulary} v ON w.term = v.term),
 l AS (SELECT doc_id, sqrt(sum(raw * raw)) AS nrm FROM r GROUP BY doc_id),
 k AS (SELECT r.doc_id, r.term, r.raw, round(r.raw / l.nrm, 4) AS score FROM r JOIN l ON r.doc_id = l.doc_id)"""


def top_sql(n: int) -> str:
    return f"""WITH {TOKENS}, {scores_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, term) AS rk FROM k)
 SELECT doc_id, CAST(rk AS INT) AS rk, term, score FROM o WHERE rk <= {n}"""


@query("tfidf_idf", f"WITH {TOKENS} SELECT term, df, round({IDF}, 6) AS idf FROM df")
def tfidf_idf(spark, sf):
    terms = tfidf.fit(documents(spark, sf)).terms
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_saved_model", f"WITH {TOKENS} SELECT term, df, round({IDF}, 6) AS idf FROM df")
def tfidf_saved_model(spark, sf):
    path = shared_path(spark, "model")
    tfidf.fit(documents(spark, sf)).save(path)
    return tfidf.TfidfModel.load(spark, path).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_plain_idf", f"WITH {TOKENS} SELECT term, df, round(ln((SELECT count(*) FROM documents) * 1.0E0 / df), 6) AS idf FROM df")
def tfidf_plain_idf(spark, sf):
    return tfidf.fit(documents(spark, sf), idf=tfidf.plain_idf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_scores", f"WITH {TOKENS}, {scores_sql()} SELECT doc_id, term, score FROM k")
def tfidf_scores(spark, sf):
    docs = documents(spark, sf)
    return tfidf.scores(tfidf.transform(docs, tfidf.fit(docs)), digits=4)


def _ranked(words):
    return words.select("doc_id", F.posexplode("tf_idf").alias("pos", "k")).select(
        "doc_id", (F.col("pos") + 1).alias("rk"), "k.term", "k.score")


@query("tfidf_keywords", top_sql(15))
def tfidf_keywords(spark, sf):
    docs = documents(spark, sf)
    return _ranked(tfidf.keywords(tfidf.transform(docs, tfidf.fit(docs)), 15))


@query("tfidf_keywords_200", top_sql(200))
def tfidf_keywords_200(spark, sf):
    docs = documents(spark, sf)
    return _ranked(tfidf.keywords(tfidf.transform(docs, tfidf.fit(docs)), 200))


@query("keyword_tagging_step", f"""WITH {TOKENS}, {scores_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, term) AS rk FROM k),
 g AS (SELECT doc_id, string_agg(term, ' ' ORDER BY rk) AS terms FROM o WHERE rk <= 200 GROUP BY doc_id)
 SELECT d.doc_id, CASE WHEN d.doc_id % 9 = 0 THEN 'kept' WHEN l.doc_id IS NOT NULL THEN g.terms END AS terms
 FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def keyword_tagging_step(spark, sf):
    """Manifest (labelled documents) and existing keywords (every ninth) decide which rows are tagged."""
    docs = documents(spark, sf).select("doc_id", "text")
    old = F.when(F.col("doc_id") % 9 == 0, F.array(F.struct(F.lit("kept").alias("term"), F.lit(1.0).alias("score"))))
    tagged = steps.tag_keywords(
        docs.withColumn("name", F.col("doc_id")).withColumn("tf_idf", old), tfidf.fit(docs),
        table(spark, sf, "labels").select(F.col("doc_id").alias("name")), key="doc_id")
    return tagged.select("doc_id", F.array_join(F.transform("tf_idf", lambda k: k["term"]), " ").alias("terms"))


VOCABULARY = f"{TOKENS}, v1000 AS (SELECT term, df, tf FROM df ORDER BY tf DESC, term LIMIT 1000)"


@query("tfidf_vocab1000", f"WITH {VOCABULARY} SELECT term, df, round({IDF}, 6) AS idf FROM v1000")
def tfidf_vocab1000(spark, sf):
    """A bounded vocabulary: the size is the feature."""
    return tfidf.fit(documents(spark, sf), max_features=1000).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_vocab1000_scores", f"WITH {VOCABULARY}, {scores_sql('v1000')} SELECT doc_id, term, score FROM k")
def tfidf_vocab1000_scores(spark, sf):
    docs = documents(spark, sf)
    return tfidf.scores(tfidf.transform(docs, tfidf.fit(docs, max_features=1000)), digits=4)
