import html
import random

from pyspark.sql import functions as F

from pressloom.functions import entities, labels, text


def one(spark, value, column, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column(F.col("x")).alias("y")).first().y


def test_paragraph_filters(spark):
    html = ("<html><body><p>One <b>two</b> three</p><p>Credit: nobody here</p><p>me@example.org wrote</p>"
            "<p>single</p><p class='x'>Fish &amp; chips &lt;3</p></body></html>")
    assert one(spark, html, text.article_paragraphs) == ["one two three", "fish & chips <3"]


def test_paragraphs_without_closing_tags(spark):
    html = "<body>lead text<p>first one<p>second one<h2>not this</h2><p>third one</body> tail <!-- <p>no no</p> --><script>'<p>x y</p>'</script>"
    assert one(spark, html, text.html_paragraphs) == ["first one", "second one", "third one"]


def test_pre_is_not_a_paragraph(spark):
    assert one(spark, "<pre>a b</pre><param>c d<p>e f</p>", text.html_paragraphs) == ["e f"]


def test_no_valid_paragraph_is_null(spark):
    assert one(spark, "<p>single</p>", text.article_paragraphs) is None
    assert one(spark, "plain", text.article_paragraphs) is None
    assert one(spark, None, text.article_paragraphs) is None


def test_word_count_is_unfiltered(spark):
    html = "<p>one two</p><p>a@b c</p><p>x</p>"
    assert one(spark, html, lambda h: text.paragraph_word_count(text.html_paragraphs(h))) == 5
    assert one(spark, "<p> </p>", lambda h: text.paragraph_word_count(text.html_paragraphs(h))) is None


def test_full_text_separator(spark):
    join = lambda sep: one(spark, ["ends", "the start"], lambda x: text.full_text(x, sep), "x array<string>")
    assert (join(" "), join("")) == ("ends the start", "endsthe start")


def test_cleaning(spark):
    assert one(spark, "  Größe—2,5\tMrd.!  ", text.clean_text) == "größe 2 5 mrd"
    assert one(spark, None, text.clean_text) is None


def test_tokens(spark):
    assert one(spark, "A big-hearted x élan_9 don't", text.tokens) == ["big", "hearted", "élan_9", "don"]
    assert one(spark, "The rates don't rise 3x, said he", text.topic_tokens) == ["rates", "dont", "rise", "x"]
    assert one(spark, ["The rates", "rise 3x fast."], text.topic_list_tokens, "x array<string>") == ["rates", "rise"]


def test_keyword_literal(spark):
    literal = """[('totoaba', 0.4342), ("chan's", 0.3), ('sea', np.float64(0.22))]"""
    assert one(spark, literal, text.keyword_terms) == ["totoaba", "chan's", "sea"]
    assert one(spark, "[]", text.keyword_terms) == []


def test_list_texts(spark):
    assert one(spark, "['a b', 'c']", text.parse_list) == ["a b", "c"]
    assert one(spark, '["it\'s", "x"]', text.parse_list) == ["it's", "x"]
    assert one(spark, "plain [text]", text.parse_list) == ["plain [text]"]
    assert one(spark, None, text.parse_list) is None


def test_model_limit_cut(spark):
    assert len(one(spark, "x" * 512, text.cut)) == 512
    assert len(one(spark, "x" * 513, text.cut)) == 511


def test_dates(spark):
    assert one(spark, "2015-01-10", labels.weekday_name) == "Saturday"
    assert one(spark, "10/01/2015", labels.weekday_name) is None
    assert one(spark, "2015-13-10", labels.weekday_name) is None
    assert one(spark, "2014-05-18", lambda d: labels.quarter_label(d.cast("date"))) == "2014Q2"


def test_classes(spark):
    label = lambda v: one(spark, v, labels.sentiment_label, "x double")
    assert [label(v) for v in (0.51, 0.5, -0.5, -0.51, None)] == ["positive", "neutral", "neutral", "negative", None]
    size = lambda v: one(spark, v, labels.size_class, "x int")
    assert [size(v) for v in (299, 300, 1000, 1001, None)] == ["small", "medium", "medium", "large", None]
    above = lambda v: one(spark, v, lambda x: labels.above_threshold(x, 0.5))
    assert [above(v) for v in ("0.5", "0.51", "None", None, "nan")] == [False, True, False, False, False]


def test_polarity(spark):
    rows = spark.createDataFrame([(0.284546, 0.715454), (0.0, 0.0), (None, 0.5)], "p double, n double")
    got = [r[0] for r in rows.select(labels.polarity(F.col("p"), F.col("n"))).collect()]
    assert abs(got[0] + 0.430908) < 1e-6 and got[1:] == [0.0, None]


def test_article_polarity(spark):
    rows = spark.createDataFrame([(0.5, -0.25), (None, -0.25), (0.5, None), (None, None)], "t double, b double")
    got = [round(r[0], 9) for r in rows.select(labels.article_polarity(F.col("t"), F.col("b"))).collect()]
    assert got == [-0.1, -0.25, 0.5, 0.0]


def test_character_references_equal_the_standard(spark):
    """Against the standard library, which leaves noncharacters and most control characters out."""
    from html.entities import html5

    rng = random.Random(1)
    bits = ["&amp;", "&#39;", "&#x27;", "&#X1F600;", "&eacute;", "&eacute", "&notit;", "&notin;", "&copy2020", "&nbsp;", "&#0;", "&#xD800;", "&#128;",
            "&#x99;", "&#99999999999;", "&#000000000065;", "&bogus;", "&", ";", "&;", "&#;", "&#x;", "& amp;", "a", "&#8217;s", "&AMP", "&amp;lt;", "&frac12x", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 6))) for _ in range(1000)] + [None, ""] + ["&" + name for name in html5]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", entities.unescape(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}


def test_paragraphs_decode_references_once_and_after_the_markup(spark):
    page = "<p>it&#8217;s caf&eacute; &mdash; time</p><p>a &lt;b&gt; &amp;lt;c</p><p>no&nbsp;break&#160;space &copy 2020</p>"
    got = spark.createDataFrame([(page,)], "h string").select(text.html_paragraphs(F.col("h")).alias("p")).first().p
    assert got == ["it’s café — time", "a <b> &lt;c", "no break space © 2020"]


def test_terms_are_counted_within_the_row(spark):
    rows = [(["b", "a", "b", "c", "b"],), (["x"],), ([],), (None,), (["y", "y"],)]
    got = [r.c for r in spark.createDataFrame(rows, "w array<string>").select(text.term_counts(F.col("w")).alias("c")).collect()]
    assert [None if c is None else [tuple(x) for x in c] for c in got] == [[("a", 1), ("b", 3), ("c", 1)], [("x", 1)], [], None, [("y", 2)]]


def test_counted_words_are_sorted_natively(spark):
    """Not by a comparison written as an expression, which is worked out for every two words."""
    plan = spark.range(1).select(text.term_counts(F.array(F.col("id").cast("string"))).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_references_of_many_texts_equal_the_standard_one_by_one(spark):
    """Decoded characters, marks and neighbours never complete a reference."""
    parts = ["&", "amp", "lt", ";", "#38", "#x26", "l", "t", "am", "\0", "\0a", "\0b", "\0c", "\0d", "&#112;", "&#108;", "&amp;", "&lt", "&alpha",
             "&alpha;", "&copyx", "&notit;", " ", "é", "&#381;", "&#38", "1", "&bne;", "&nbsp;", "&#x110000;", "&#59;"]
    pick = random.Random(7)
    texts = [["".join(pick.choice(parts) for _ in range(pick.randint(0, 10))) for _ in range(pick.randint(0, 3))] for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t array<string>").select("i", entities.unescape_all(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: [html.unescape(t) for t in ts] for i, ts in enumerate(texts)}


def test_a_paragraph_is_cut_and_decoded_once(spark):
    """The costly expressions of a page stand once in the plan, and a reference is decoded once however often it stands there."""
    rows = spark.createDataFrame([("<p>a &amp; b",)], "h string").select(text.html_paragraphs(F.col("h")).alias("p"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("blockquote") == 1 and plan.count("array_distinct") == 1 and rows.first().p == ["a & b"]


def test_paragraph_ends_equal_the_pattern(spark):
    """What cuts a paragraph is the end that ``PARAGRAPH_BODY`` names."""
    tags = ["</p>", "</P >", "<div>", "</div", "<hr/>", "<b>", "</b>", "<h3 class='x'>", "<h7>", "<p>", "\n", "x y", "<", ">", "<!-- a -->", "<table\n>", "</section >"]
    pick = random.Random(3)
    pages = ["".join(pick.choice(tags) for _ in range(pick.randint(0, 12))) for _ in range(2000)]
    rows = spark.createDataFrame([(p,) for p in pages], "h string")
    pieces = F.split(F.regexp_replace("h", text.HIDDEN_HTML, ""), text.PARAGRAPH_OPEN)
    want = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.regexp_replace(F.regexp_replace(
        F.regexp_extract(p, text.PARAGRAPH_BODY, 1), "<[^>]*>", ""), r"^\s+|\s+$", ""))
    assert rows.filter(~text.html_paragraphs(F.col("h")).eqNullSafe(want)).count() == 0


def test_counted_words_are_made_once(spark):
    """The words stand once in the plan, with no second copy outside the binding."""
    rows = spark.createDataFrame([("b a b",), (None,)], "t string")
    counted = rows.select(text.term_counts(text.topic_tokens(F.col("t"), ())).alias("c"))
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.c and [tuple(x) for x in r.c] for r in counted.collect()] == [[("a", 1), ("b", 2)], None]


def test_markup_is_removed_once(spark):
    """Markup is cut and a paragraph is lowered once; a page without references comes out like one with them."""
    pages = ["<p>X <i>y</i> Z</p><p>Credit: A b</p>", "<p>X &amp; <i>y</i></p><p>a &lt;b</p>", None, "no paragraph"]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, h string").select("i", text.article_paragraphs(F.col("h")).alias("p"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]*>") == 1 and plan.count("lower(") == 1
    assert [r.p for r in rows.orderBy("i").collect()] == [["x y z"], ["x & y", "a <b"], None, None]
    texts = spark.createDataFrame([(["a", None, "\0b"],), ([],), (None,)], "t array<string>")
    assert [r.u for r in texts.select(entities.unescape_all(F.col("t")).alias("u")).collect()] == [["a", None, "\0b"], [], None]
