"""Schemas and fixed values of the article data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Source tags and the column names they become, position by position.
PROPERTY_TAGS = (
    "GOID", "SortTitle", "NumericDate", "mstar", "DocSection", "GenSubjTerm", "StartPage",
    "WordCount", "Title", "Text", "CompanyName", "Personal", "LexileScore",
)
PROPERTY_NAMES = (
    "goid", "publisher", "date", "article_type", "section", "tdm_topic_tags", "page",
    "word_count", "title", "paragraph_text", "company_name", "author", "lexile_score",
)
# Fixed value: the export spells this column as the result files do.
CSV_TEXT_COLUMN = "paragrph_text"

# ``author`` holds the first person indexed for the article, not its writer.
ARTICLE_SCHEMA = T.StructType([
    T.StructField("goid", T.StringType()),
    T.StructField("publisher", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("article_type", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("tdm_topic_tags", T.StringType()),
    T.StructField("page", T.StringType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("paragraph_text", T.ArrayType(T.StringType())),
    T.StructField("company_name", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("lexile_score", T.IntegerType()),
])

KEYWORDS_TYPE = T.ArrayType(T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("score", T.DoubleType()),
]))

# The ``processed`` tags are an open set of names, so they are a map at the XML boundary only.
RECORD_SCHEMA = T.StructType([
    T.StructField("GOID", T.StringType()),
    T.StructField("Obj", T.StructType([
        T.StructField("ObjectTypes", T.StructType([
            T.StructField("mstar", T.ArrayType(T.StringType())),
        ])),
        T.StructField("TitleAtt", T.StructType([
            T.StructField("Title", T.ArrayType(T.StringType())),
        ])),
        T.StructField("NumericDate", T.StringType()),
        T.StructField("PrintLocation", T.StructType([
            T.StructField("StartPage", T.StringType()),
            T.StructField("DocSection", T.StringType()),
        ])),
        T.StructField("LexileScore", T.StringType()),
        T.StructField("Terms", T.StructType([
            T.StructField("GenSubjTerm", T.ArrayType(T.StructType([
                T.StructField("GenSubjValue", T.StringType()),
            ]))),
            T.StructField("Term", T.ArrayType(T.StructType([
                T.StructField("Personal", T.StringType()),
                T.StructField("CompanyName", T.StringType()),
            ]))),
        ])),
    ])),
    T.StructField("TextInfo", T.StructType([
        T.StructField("Text", T.StructType([
            T.StructField("_VALUE", T.StringType()),
            T.StructField("_WordCount", T.StringType()),
        ])),
    ])),
    T.StructField("DFS", T.StructType([
        T.StructField("PubFrosting", T.StructType([
            T.StructField("SortTitle", T.ArrayType(T.StringType())),
        ])),
    ])),
    T.StructField("processed", T.MapType(T.StringType(), T.StringType())),
])

# Columns of the text-free export, in file order.
EXPORT_COLUMNS = (
    "goid", "publisher", "date", "article_type", "section", "tdm_topic_tags", "page", "word_count",
    "company_name", "is_economic", "bert_sentiment", "title_sentiment", "title_positive_prob",
    "title_neutral_prob", "title_negative_prob", "paragraph_avg_positive", "paragraph_avg_neutral",
    "paragraph_avg_negative", "tf_idf_tags",
)

# Label -> column, per model and article part.
ROBERTA_TITLE = {label: f"roberta_title_{label}" for label in ("negative", "neutral", "positive")}
ROBERTA_PARAGRAPH = {label: f"roberta_paragraph_{label}" for label in ("negative", "neutral", "positive")}
BERT_TITLE = {label: f"bert_title_{label}" for label in ("negative", "positive")}
BERT_PARAGRAPH = {label: f"bert_paragraph_{label}" for label in ("negative", "positive")}

# Publisher names that are one paper under several titles.
PUBLISHER_ALIASES = {
    "international herald tribune": "new york times",
    "new york times the": "new york times",
    "international new york times": "new york times",
    "los angeles times (pre-1997 fulltext)": "los angeles times",
    "washington post (pre-1997 fulltext) the": "washington post the",
}
ONLINE_ALIASES = {**PUBLISHER_ALIASES, "usa today (online)": "usa today"}
EXCLUDED_PUBLISHER = "new york times español"

# Words per printed page.
PAGE_SIZES = {
    "new york times": 1188,
    "usa today": 1007,
    "washington post the": 1154,
    "los angeles times": 771,
    "chicago tribune": 940,
}

# Page scores for page 1, 2, 3 and any other, by section letter.
PAGE_SCORES = {
    "a": (1.0, 0.9, 0.8, 0.7),
    "b": (0.9, 0.8, 0.7, 0.6),
    "c": (0.9, 0.8, 0.7, 0.6),
}
OTHER_PAGE_SCORES = (0.8, 0.7, 0.6, 0.5)

# Weekday weights.
DAY_SCORES = {"sunday": 1.0, "saturday": 0.9}
OTHER_DAY_SCORE = 0.8

# Newspaper sections that label an article as economic or not.
ECONOMIC_SECTIONS = ("money", "business", "finance/business", "business; part b; business desk", "financial")
OTHER_SECTIONS = ("outlook", "arts & entertainment", "style", "movies", "arts", "life")

# The English stop list of the topic model, also our default for TF-IDF.
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've now
d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't
wasn wasn't weren weren't won won't wouldn wouldn't
aa aaa aac aapi aaron aarp ab aba aback said say like rd dr
""".split())

# Subject terms that mark an article as economic, first list (title case).
ECONOMIC_TAGS_INDEXED = (
    "Acquisitions & Mergers", "Bank Acquisitions & Mergers", "Banking Industry", "Banks", "Bankruptcy",
    "Bankruptcy Reorganization", "Bailouts", "Budgets", "Budget Deficits", "Business Closings",
    "Central Banks", "Commercial Real Estate", "Corporate Governance", "Corporate Profits",
    "Credit Cards", "Currency", "Economic Conditions", "Economic Crisis", "Economic Forecasts",
    "Economic Growth", "Economic Impact", "Economic Indicators", "Economic Policy", "Economic Recovery",
    "Economic Statistics", "Economists", "Federal Budget", "Federal Reserve Monetary Policy",
    "Financial Performance", "Financial Services", "Foreign Investment", "Government Spending",
    "Inflation", "Interest Rates", "International Finance", "International Trade",
    "Investment Advisors", "Investment Banking", "Investment Bankers", "Investment Policy",
    "Investments", "Lending", "Loans", "Monetary Policy", "Mortgage Companies", "Mortgages",
    "Pension Funds", "Real Estate Sales", "Recessions", "Regulation of Financial Institutions",
    "Retail Sales", "Small Business", "Unemployment", "Unemployment Benefits",
)
# Second list (lower case).
ECONOMIC_TAGS_OBSERVED = (
    "real estate sales", "recessions", "interest rates", "economic conditions", "workers",
    "international trade", "unemployment", "layoffs", "manufacturing", "retail stores", "prices",
    "gasoline prices", "small business", "inflation", "real estate", "federal budget", "housing",
    "strikes", "labor unions", "wage & price controls", "labor force", "supply chains",
    "great recession", "industrial production", "budget surplus", "TARP funds", "market prices",
    "bailoutsfinanceeconomics", "personal income", "foreign investments in the us",
    "service industries", "real estate companies", "price cuts", "corporate debt",
    "predatory lending", "currencies", "economic trends", "economic recoveryeconomics",
    "offshore banking", "public finance", "cost of living", "borrowing", "currency revaluation",
    "subsidies", "currency devaluation", "treasury notes", "government bonds",
    "economic development corporations", "imports", "consumer goods", "new store openings",
    "budgets", "economic growth", "bank acquisitions & mergers", "pension funds", "wages & salaries",
    "corporate profits", "state budgets", "unemployment benefits", "budget deficits", "minimum wage",
    "housing prices", "international finance", "economic forecasts", "monetary policy",
    "government spending", "consumers", "budgeting", "labor contracts", "collective bargaining",
    "banks", "financial services", "labor negotiations", "employees", "workforce planning",
    "corporate governance", "hostile takeovers", "mortgage companies", "shutdowns",
    "venture capital companies", "economic recovery", "supply chains", "foreclosure", "exports",
    "economic policy", "trade agreements", "economic crisis", "economic statistics", "poverty",
    "subprime lending", "investment banking",
)


def properties() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Source tags and output names, in the same order."""
    return PROPERTY_TAGS, PROPERTY_NAMES
