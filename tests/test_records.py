"""XML records from small invented files."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pressloom.schema import PROPERTY_NAMES, PROPERTY_TAGS, properties
from pressloom.sources import records

FULL = """<?xml version="1.0" encoding="utf-8"?>
<RECORD><GOID>1001</GOID><Obj><ObjectTypes><mstar>News</mstar></ObjectTypes>
<TitleAtt><Title>Alpha beta</Title></TitleAtt><NumericDate>2010-05-16</NumericDate>
<PrintLocation><StartPage>A.01</StartPage><DocSection>MONEY</DocSection></PrintLocation><LexileScore>900</LexileScore>
<Terms><GenSubjTerm><GenSubjValue>Budgets</GenSubjValue></GenSubjTerm><GenSubjTerm><GenSubjValue>Banks</GenSubjValue></GenSubjTerm>
<Term><CompanyName>Acme Inc</CompanyName></Term><Term><Personal>Doe, J</Personal></Term></Terms></Obj>
<TextInfo><Text HTMLContent="true" WordCount="9">&lt;html&gt;&lt;body&gt;&lt;p&gt;One &lt;b&gt;two&lt;/b&gt; three&lt;/p&gt;&lt;p&gt;Credit: nobody&lt;/p&gt;&lt;p&gt;me@example.org wrote&lt;/p&gt;&lt;p&gt;single&lt;/p&gt;&lt;/body&gt;&lt;/html&gt;</Text></TextInfo>
<DFS><PubFrosting><Title>USA Today</Title><SortTitle>USA TODAY</SortTitle></PubFrosting></DFS>
<processed><is_economic>0.4</is_economic><tf_idf>[('one', 0.5), ('two', 0.25)]</tf_idf></processed></RECORD>"""
BARE = "<RECORD><GOID>1002</GOID><Obj><TitleAtt><Title>No text</Title></TitleAtt></Obj></RECORD>"
OPEN = """<RECORD><GOID>1004</GOID><TextInfo><Text WordCount="4">&lt;p&gt;first one&lt;p&gt;second one</Text></TextInfo></RECORD>"""
EMPTY = """<RECORD><GOID>1005</GOID><TextInfo><Text WordCount="1">&lt;p&gt;single&lt;/p&gt;</Text></TextInfo></RECORD>"""


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpora")
    for folder, goid, body in [
        ("TimesA", 1001, FULL), ("TimesA", 1002, BARE), ("TimesA", 1003, '<?xml version="1.0" encoding="utf-8"?>\n'),
        ("TimesB", 1004, OPEN), ("TimesB", 1005, EMPTY),
    ]:
        (root / folder).mkdir(exist_ok=True)
        (root / folder / f"{goid}.xml").write_text(body)
    return str(root)


def test_full_record(spark, corpus):
    row = records.load(spark, corpus, tags=["is_economic", "tf_idf", "bert_sentiment"]).filter("goid = '1001'").first()
    assert row.asDict() == {
        "corpus": "TimesA", "name": "1001.xml", "goid": "1001", "publisher": "usa today", "date": date(2010, 5, 16),
        "article_type": "News", "section": "MONEY", "tdm_topic_tags": "Budgets", "page": "A.01", "word_count": 9,
        "title": "Alpha beta", "paragraph_text": ["one two three"], "company_name": "Acme Inc", "author": "Doe, J",
        "lexile_score": 900, "is_economic": "0.4", "tf_idf": ["one", "two"], "bert_sentiment": None,
    }


def test_every_record_keeps_its_row(spark, corpus):
    rows = {r.goid: r for r in records.load(spark, corpus).collect()}
    assert sorted(rows) == ["1001", "1002", "1004", "1005"]
    assert rows["1002"].title == "No text" and rows["1002"].paragraph_text is None and rows["1002"].word_count is None
    assert rows["1004"].paragraph_text == ["first one", "second one"]
    assert rows["1005"].paragraph_text is None and rows["1005"].word_count == 1


def test_errors(spark, corpus):
    got = sorted(tuple(r) for r in records.load_errors(spark, corpus).collect())
    assert got == [("TimesA", "1002.xml", "no text"), ("TimesA", "1003.xml", "no record")]


def test_manifest(spark, corpus):
    manifest = spark.createDataFrame([("1004.xml",), ("1004.xml",), ("9.xml",)], "name string")
    assert [r.goid for r in records.load(spark, corpus, manifest).collect()] == ["1004"]
    every = spark.createDataFrame([(f"{n}.xml",) for n in range(1001, 1006)], "name string")
    whole, listed = (sorted(map(str, df.select(*PROPERTY_NAMES, "corpus", "name", "is_economic").collect()))
                     for df in (records.load(spark, corpus, None, ["is_economic"]), records.load(spark, corpus, every, ["is_economic"])))
    assert whole == listed and len(whole) == 4


def test_all_topic_tags(spark, corpus):
    rows = records.read_records(spark, corpus).filter("GOID = '1001'").select(records.all_topic_tags().alias("t"))
    assert rows.first().t == ["Budgets", "Banks"]


def test_tag_value(spark):
    row = spark.createDataFrame([(FULL,)], "xml string").select(
        records.tag_value(F.col("xml"), "Title").alias("title"), records.tag_value(F.col("xml"), "grades").alias("grades")).first()
    assert (row.title, row.grades) == ("Alpha beta", None)


def test_written_records_read_back(spark, corpus, tmp_path):
    first = records.load(spark, corpus, tags=["is_economic"])
    records.write_records(first, str(tmp_path / "out"), ["is_economic"])
    again = records.articles(records.read_records(spark, str(tmp_path / "out"), "part-*"), ["is_economic"])
    columns = [*PROPERTY_NAMES, "is_economic"]
    rows = [sorted((tuple(r) for r in df.select(columns).collect()), key=repr) for df in (first, again)]
    assert rows[0] == rows[1]


def test_expected_columns(spark):
    df = records.expected_columns(spark.createDataFrame([("1", "x")], "goid string, extra string"), ["is_economic"])
    assert df.columns == [*PROPERTY_NAMES, "is_economic"] and df.first().goid == "1"


def test_properties():
    tags, names = properties()
    assert tags == PROPERTY_TAGS and names == PROPERTY_NAMES and len(tags) == len(names) == 13
    assert names[tags.index("Personal")] == "author"


def test_malformed_records_are_quarantined(spark, tmp_path):
    """A record cut short, wrong end tags, bare ampersands, illegal characters: no articles, and listed as such."""
    files = {"a/good.xml": record("1"), "a/cut.xml": record("2")[:-20], "b/tag.xml": record("3").replace("</GOID>", "</GOIDS>"),
             "b/amp.xml": record("4 & 5"), "b/none.xml": "<OTHER/>", "b/char.xml": record("\x01"),
             "b/two.xml": "<R>" + record("6") + record("7").replace("</GOID>", "") + record("8") + "</R>"}
    for path, xml in files.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(xml)
    rows = records.load(spark, str(tmp_path)).collect()
    assert sorted(r.goid for r in rows) == ["1", "6"]
    listed = {(r.corpus, r.name): r.error for r in records.load_errors(spark, str(tmp_path)).collect()}
    bad = {(*p.split("/"),): "malformed" for p in ("a/cut.xml", "b/tag.xml", "b/amp.xml", "b/char.xml", "b/two.xml")}
    assert listed == bad | {("b", "none.xml"): "no record"}
    kept = records.malformed(records.read_records(spark, str(tmp_path))).collect()
    assert {(r.corpus, r.name) for r in kept} == set(bad) and all("RECORD" in r.xml for r in kept)
    manifest = spark.createDataFrame([("a", "good.xml"), ("b", "amp.xml"), ("b", "good.xml")], "corpus string, name string")
    assert [r.goid for r in records.load(spark, str(tmp_path), manifest).collect()] == ["1"]


def record(goid):
    return f"<RECORD><GOID>{goid}</GOID><TextInfo><Text WordCount='2'>&lt;p&gt;one two&lt;/p&gt;</Text></TextInfo></RECORD>"


def test_a_record_is_printed_and_parsed_once(spark):
    """A filter on what was read from a record neither parses nor prints it again."""
    rows = spark.createDataFrame([("1", ["a b"])], "goid string, paragraph_text array<string>")
    full = records.expected_columns(rows)
    printed = records.record_xml(records.to_records(full)).filter(F.contains("xml", F.lit("<RECORD")))
    out = records.load_from_text(printed.select("xml"), "xml")
    plan = out.select("goid", "paragraph_text")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("xmltostructs(") + plan.count("from_xml(") == 1 and plan.count("structstoxml(") + plan.count("to_xml(") == 1
    assert [(r.goid, r.paragraph_text) for r in out.collect()] == [("1", ["a b"])]
