"""Lexicon sentiment, polarity and the economic classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import classify, sentiment, tfidf
from ..plans import steps
from ..schema import BERT_PARAGRAPH, BERT_TITLE, ROBERTA_PARAGRAPH, ROBERTA_TITLE
from ..session import materialise, shared_path, spread
from ..sources import enrichment
from .base import ARTICLES, TITLED, articles, documents, query, table, term_mark, titled, tokens_sql
from .cleaning import sections
from .text import IDF, VOCABULARY

THREE, TWO = sentiment.RuleScorer(term_mark, 3), sentiment.RuleScorer(term_mark, 2)


def counts_sql(source: str, keys: str, column: str) -> str:
    """(keys, p, n, u): positive, negative and other tokens of each text."""
    return f"""(SELECT {keys}, len(list_filter(ts, lambda t: substr(md5(t), 1, 1) IN ('0', '1'))) AS p,
 len(list_filter(ts, lambda t: substr(md5(t), 1, 1) IN ('2', '3'))) AS n, len(ts) AS a
 FROM (SELECT {keys}, {tokens_sql(column)} AS ts FROM {source} WHERE {column} IS NOT NULL))"""


SHARES = """round((n + 1) * 1.0E0 / (a + 3), 4) AS negative, round((a - p - n + 1) * 1.0E0 / (a + 3), 4) AS neutral,
 round((p + 1) * 1.0E0 / (a + 3), 4) AS positive"""
PAIR = "round((n + 1) * 1.0E0 / (p + n + 2), 4) AS negative, round((p + 1) * 1.0E0 / (p + n + 2), 4) AS positive"
PARAGRAPHS = f"""{TITLED}, para AS (SELECT goid, unnest(paragraph_text) AS paragraph, generate_subscripts(paragraph_text, 1) - 1 AS pos FROM titled),
 ps AS (SELECT goid, pos, {SHARES} FROM {counts_sql('para', 'goid, pos', 'paragraph')}),
 pair AS (SELECT goid, pos, {PAIR} FROM {counts_sql('para', 'goid, pos', 'paragraph')}),
 ts AS (SELECT goid, {SHARES} FROM {counts_sql('titled', 'goid', 'title')}),
 tpair AS (SELECT goid, {PAIR} FROM {counts_sql('titled', 'goid', 'title')})"""


@query("lexicon_sentiment", f"SELECT doc_id, {SHARES} FROM {counts_sql('documents', 'doc_id', 'text')}")
def lexicon_sentiment(spark, sf):
    """The word table is every marked term of the corpus, so it grows with the data."""
    docs = documents(spark, sf).select("doc_id", "text")
    terms = tfidf.document_frequencies(docs, "text", ())
    lexicon = terms.select("term", term_mark(F.col("term")).alias("mark"), "df").filter(F.col("mark") != 0)
    scorer = sentiment.LexiconScorer(materialise(lexicon, "lexicon"), 3)
    return sentiment.score_texts(docs, "text", ["doc_id"], scorer)


@query("lexicon_sentiment_two_label", f"SELECT doc_id, {PAIR} FROM {counts_sql('documents', 'doc_id', 'text')}")
def lexicon_sentiment_two_label(spark, sf):
    docs = spread(documents(spark, sf).select("doc_id", "text"))
    return sentiment.score_texts(docs, "text", ["doc_id"], TWO)


@query("model_scorer_batches", f"SELECT doc_id, {SHARES} FROM {counts_sql('documents', 'doc_id', 'text')}")
def model_scorer_batches(spark, sf):
    """The same shares from a Python model behind the batch contract."""
    def load():
        import hashlib
        import regex
        token = regex.compile(r"[\p{L}\p{N}_]{2,}")

        def share(value):
            marks = [hashlib.md5(t.encode()).hexdigest()[0] for t in token.findall(value.lower())]
            p, n = sum(m in "01" for m in marks), sum(m in "23" for m in marks)
            total = len(marks) + 3
            return {"NEGATIVE": (n + 1) / total, "NEUTRAL": (len(marks) - p - n + 1) / total, "POSITIVE": (p + 1) / total}

        return lambda texts: [share(t) for t in texts]

    docs = spread(documents(spark, sf).select("doc_id", "text"))
    return sentiment.score_texts(docs, "text", ["doc_id"], sentiment.ModelScorer(load))


@query("paragraph_sentiment", f"WITH {PARAGRAPHS} SELECT goid, CAST(pos AS INT) AS pos, negative, neutral, positive FROM ps")
def paragraph_sentiment(spark, sf):
    return sentiment.paragraph_scores(titled(spark, sf), THREE)


def _mean(c: str) -> str:
    """Half-up mean of four-digit shares in whole ten-thousandths."""
    return f"CAST((2 * sum(CAST(round({c} * 10000) AS BIGINT)) + count({c})) // (2 * count({c})) AS DOUBLE) / 10000.0E0"


_AVG = "SELECT t.goid, " + ", ".join(f"coalesce({_mean(c)}, 0.0E0) AS {c}" for c in ("negative", "neutral", "positive")) \
    + " FROM titled t LEFT JOIN ps ON t.goid = ps.goid GROUP BY t.goid"


@query("paragraph_sentiment_avg", f"WITH {PARAGRAPHS} {_AVG}")
def paragraph_sentiment_avg(spark, sf):
    return sentiment.paragraph_average(titled(spark, sf), THREE)


@query("title_sentiment_step", f"""WITH {PARAGRAPHS} SELECT t.goid, """ + ", ".join(
    f"CASE WHEN t.goid % 5 = 0 THEN 0.5E0 ELSE {label} END AS {c}" for label, c in ROBERTA_TITLE.items()) + " FROM titled t LEFT JOIN ts ON t.goid = ts.goid")
def title_sentiment_step(spark, sf):
    rows = titled(spark, sf).select("goid", "title", *[F.when(F.col("goid") % 5 == 0, 0.5).alias(c) for c in ROBERTA_TITLE.values()])
    return sentiment.title_step(rows, THREE, ROBERTA_TITLE).drop("title")


def _step_sql(avg: str, title: str, titles: dict, paras: dict) -> str:
    columns = [f"CASE WHEN m.doc_id IS NOT NULL THEN ti.{k} END AS {c}" for k, c in titles.items()]
    columns += [f"CASE WHEN m.doc_id IS NOT NULL THEN coalesce(av.{k}, 0.0E0) END AS {c}" for k, c in paras.items()]
    means = ", ".join(f"{_mean(k)} AS {k}" for k in paras)
    return f"""WITH {PARAGRAPHS}, av AS (SELECT goid, {means} FROM {avg} GROUP BY goid)
 SELECT t.goid, {', '.join(columns)} FROM titled t LEFT JOIN labels m ON t.goid = m.doc_id
 LEFT JOIN {title} ti ON t.goid = ti.goid LEFT JOIN av ON t.goid = av.goid"""


def _step(spark, sf, scorer, titles, paras):
    rows = titled(spark, sf).select("goid", F.col("goid").alias("name"), "title", "paragraph_text")
    manifest = table(spark, sf, "labels").select(F.col("doc_id").alias("name"))
    return steps.score_sentiment(rows, scorer, titles, paras, manifest).select("goid", *titles.values(), *paras.values())


@query("three_label_step", _step_sql("ps", "ts", ROBERTA_TITLE, ROBERTA_PARAGRAPH))
def three_label_step(spark, sf):
    return _step(spark, sf, THREE, ROBERTA_TITLE, ROBERTA_PARAGRAPH)


@query("enriched_step", f"SELECT lang AS corpus, CAST(s.goid AS VARCHAR) AS goid, s.* EXCLUDE (goid) FROM ("
       + _step_sql("ps", "ts", ROBERTA_TITLE, ROBERTA_PARAGRAPH) + ") s JOIN documents d ON s.goid = d.doc_id WHERE s.goid IN (SELECT doc_id FROM labels)")
def enriched_step(spark, sf):
    """The same columns as versions of an enrichment table: two halves, the second again, compacted and read back."""
    path = shared_path(spark, "enrichment")
    rows = titled(spark, sf).select(F.col("lang").alias("corpus"), F.col("goid").cast("string").alias("goid"), "title", "paragraph_text")
    manifest = rows.join(table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("goid")), "goid", "left_semi").select("corpus", "goid")
    first = F.col("goid").cast("long") % 2 == 0
    for part in (first, ~first, ~first):
        steps.enrich_sentiment(rows, THREE, ROBERTA_TITLE, ROBERTA_PARAGRAPH, path, manifest.filter(part))
    columns = ", ".join(f"{c} double" for c in (*ROBERTA_TITLE.values(), *ROBERTA_PARAGRAPH.values()))
    enrichment.compact(spark, path, columns)
    enrichment.drop_compacted(spark, path)
    return enrichment.read(spark, path, columns)


@query("two_label_step", _step_sql("pair", "tpair", BERT_TITLE, BERT_PARAGRAPH))
def two_label_step(spark, sf):
    return _step(spark, sf, TWO, BERT_TITLE, BERT_PARAGRAPH)


def _polarity(p: str = "positive", n: str = "negative") -> str:
    return f"CASE WHEN {p} + {n} = 0 THEN 0.0E0 ELSE ({p} - {n}) / ({p} + {n}) END"


@query("polarity", f"WITH s AS (SELECT doc_id, {SHARES} FROM {counts_sql('documents', 'doc_id', 'text')}) SELECT doc_id, round({_polarity()}, 6) AS polarity FROM s")
def polarity(spark, sf):
    scored = sentiment.score_texts(spread(documents(spark, sf).select("doc_id", "text")), "text", ["doc_id"], THREE)
    return scored.select("doc_id", F.round(labels.polarity(F.col("positive"), F.col("negative")), 6).alias("polarity"))


@query("text_list_polarity", f"WITH {PARAGRAPHS} SELECT goid, round(avg({_polarity()}), 6) AS polarity FROM ps GROUP BY goid")
def text_list_polarity(spark, sf):
    rows = sentiment.list_polarity(sentiment.paragraph_scores(titled(spark, sf), THREE))
    return rows.withColumn("polarity", F.round("polarity", 6))


@query("article_polarity", f"""WITH {PARAGRAPHS}, tp AS (SELECT goid, {_polarity()} AS tp FROM ts JOIN titled USING (goid) WHERE length(title) > 0),
 bp AS (SELECT goid, avg({_polarity()}) AS bp FROM ps GROUP BY goid)
 SELECT t.goid, round(CASE WHEN tp IS NULL AND bp IS NULL THEN 0.0E0 ELSE
 (coalesce(tp, 0) * 0.2E0 + coalesce(bp, 0) * 0.8E0) / (CASE WHEN tp IS NULL THEN 0.0E0 ELSE 0.2E0 END + CASE WHEN bp IS NULL THEN 0.0E0 ELSE 0.8E0 END) END, 6) AS sentiment
 FROM titled t LEFT JOIN tp ON t.goid = tp.goid LEFT JOIN bp ON t.goid = bp.goid""")
def article_polarity(spark, sf):
    return sentiment.article_sentiment(titled(spark, sf), THREE).select("goid", F.round("sentiment", 6).alias("sentiment"))


# --- classifier ------------------------------------------------------------------------------

@query("classification_report", """WITH p AS (SELECT l.quality AS label, round((d.doc_id * 37 % 1000) / 1000.0E0, 3) AS probability
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id), t AS (SELECT unnest([0.5E0, 0.7E0]) AS threshold),
 n AS (SELECT threshold, count(*) FILTER (label = 1 AND probability >= threshold) * 1.0E0 AS tp, count(*) FILTER (label <> 1 AND probability >= threshold) * 1.0E0 AS fp,
 count(*) FILTER (label = 1 AND probability < threshold) * 1.0E0 AS fn, count(*) FILTER (label <> 1 AND probability < threshold) * 1.0E0 AS tn FROM p, t GROUP BY threshold),
 c AS (SELECT threshold, '0' AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS precision, coalesce(tn / nullif(tn + fp, 0), 0) AS recall, tn + fp AS support FROM n
 UNION ALL SELECT threshold, '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), tp + fn FROM n),
 f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM c),
 u AS (SELECT threshold, class, precision, recall, f1, support FROM f
 UNION ALL SELECT threshold, 'accuracy', (tp + tn) / (tp + fp + fn + tn), (tp + tn) / (tp + fp + fn + tn), (tp + tn) / (tp + fp + fn + tn), tp + fp + fn + tn FROM n
 UNION ALL SELECT threshold, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f GROUP BY threshold
 UNION ALL SELECT threshold, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f GROUP BY threshold)
 SELECT threshold, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u""")
def classification_report(spark, sf):
    rows = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(
        F.col("quality").alias("label"), F.expr("round((doc_id * 37 % 1000) / 1000.0E0, 3)").alias("probability"))
    reports = [classify.classification_report(rows, threshold=t).withColumn("threshold", F.lit(t)) for t in (0.5, 0.7)]
    both = reports[0].unionByName(reports[1])
    return both.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_COEFFICIENT = "(CAST(concat('0x', substr(md5(term), 1, 4)) AS BIGINT) % 2001 - 1000) / 200.0E0"


@query("economic_probability", f"""WITH {VOCABULARY}, r AS (SELECT w.doc_id, w.term, w.tf * ({IDF}) AS raw FROM w JOIN v1000 v ON w.term = v.term),
 l AS (SELECT doc_id, sqrt(sum(raw * raw)) AS nrm FROM r GROUP BY doc_id),
 m AS (SELECT r.doc_id, sum(raw / nrm * {_COEFFICIENT}) AS margin FROM r JOIN l ON r.doc_id = l.doc_id GROUP BY r.doc_id)
 SELECT d.doc_id, round(1.0E0 / (1.0E0 + exp(-(coalesce(margin, 0) - 0.25E0))), 4) AS is_economic FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id""")
def economic_probability(spark, sf):
    """Probabilities from a stored coefficient per vocabulary term."""
    docs = documents(spark, sf).select("doc_id", "text")
    model = tfidf.fit(docs, max_features=classify.FEATURES)
    digits = F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("long")
    coefficients = model.terms.select("term", ((digits % 2001 - 1000) / F.lit(200.0)).alias("coefficient"))
    return classify.score_with_coefficients(docs, model, coefficients, -0.25, "doc_id").select("doc_id", "is_economic")


@query("economic_selection_run", f"""WITH {VOCABULARY}, r AS (SELECT w.doc_id, w.term, w.tf * ({IDF}) AS raw FROM w JOIN v1000 v ON w.term = v.term),
 l AS (SELECT doc_id, sqrt(sum(raw * raw)) AS nrm FROM r GROUP BY doc_id),
 m AS (SELECT r.doc_id, sum(raw / nrm * {_COEFFICIENT}) AS margin FROM r JOIN l ON r.doc_id = l.doc_id GROUP BY r.doc_id)
 SELECT lang AS corpus, concat(d.doc_id, '.xml') AS name, round(1.0E0 / (1.0E0 + exp(-(coalesce(margin, 0) - 0.25E0))), 4) AS is_economic,
 round(1.0E0 / (1.0E0 + exp(-(coalesce(margin, 0) - 0.25E0))), 4) > 0.5 AS selected FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id WHERE text IS NOT NULL""")
def economic_selection_run(spark, sf):
    """Two languages, then all: the second run scores what the log does not hold; choice and log are committed together."""
    root = shared_path(spark, "selection")
    docs = documents(spark, sf).select(F.col("lang").alias("corpus"), F.concat(F.col("doc_id").cast("string"), F.lit(".xml")).alias("name"), "doc_id", "text")
    model = tfidf.fit(docs.select("doc_id", "text"), max_features=classify.FEATURES, key="doc_id")
    digits = F.conv(F.substring(F.md5("term"), 1, 4), 16, 10).cast("long")
    coefficients = model.terms.select("term", ((digits % 2001 - 1000) / F.lit(200.0)).alias("coefficient"))

    def score(df):
        return classify.score_with_coefficients(df, model, coefficients, -0.25, "doc_id")

    for part in (docs.filter(F.col("corpus").isin("en", "fr")), docs):
        steps.run_selection(part, score, f"{root}/data", f"{root}/progress")
    return steps.selection(spark, f"{root}/data", f"{root}/progress")


@query("economic_train_score")
def economic_train_score(spark, sf):
    """Train on labelled sections, score every document."""
    model, _ = classify.train(sections(spark, sf))
    return classify.score(articles(spark, sf).select("goid", "text"), model)


@query("economic_train_report")
def economic_train_report(spark, sf):
    model, test = classify.train(sections(spark, sf))
    scored = materialise(classify.score(test, model, name="probability").select("label", "probability"), "scored")
    reports = [classify.classification_report(scored, threshold=t).withColumn("threshold", F.lit(t)) for t in (0.5, 0.7)]
    return reports[0].unionByName(reports[1])


@query("economic_selection_step")
def economic_selection_step(spark, sf):
    """Names of the articles a freshly trained model puts above 0.5."""
    model, _ = classify.train(sections(spark, sf))
    return steps.select_economic(articles(spark, sf).select("goid", "text"), model)[1]


@query("selected_manifest", f"WITH {ARTICLES} SELECT concat(goid, '.xml') AS name FROM articles WHERE is_economic > 0.2")
def selected_manifest(spark, sf):
    return steps.selected_names(articles(spark, sf), 0.2)
