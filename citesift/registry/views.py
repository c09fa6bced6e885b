"""The screening data model laid over the test tables, for Spark and as SQL text.

Titles are first lines, abstracts the remainder, ``toxic`` plays the rare relevant
class. Whole tables and whole texts are used throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.functions.text import padded_text, tokenize
from citesift.functions.words import CLOSED_CLASS, IRREGULAR_FORMS
from citesift.operators.articles import build_records
from citesift.operators.folds import stratified_folds
from citesift.operators.retrieval import Query
from citesift.session import durable, spread

URL_PREFIX = "https://docs.example.org/"

# Texts lie in few files, so they are dealt over the session's shuffle partitions: a fixed
# number of parts would make each as large as the tables grow.
PARTS = 0

QUERIES = (
    Query("the AND (und OR der)", (("the",), ("und", "der"))),
    Query("la AND de", (("la",), ("de",))),
    Query("the AND (with OR therou*)", (("the",), ("with", "therou*"))),
    Query("of AND tion", (("of",), ("tion",))),
    Query("en AND (le OR es OR on)", (("en",), ("le", "es", "on"))),
)

# Weights of the fixed score, and its intercept.
SCORE_WEIGHTS = {"the": 0.6, "of": 0.4, "und": -0.9, "der": -0.5, "la": -0.7, "de": 0.3, "tion": 0.5}
SCORE_INTERCEPT = -1.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread by their id for work on their texts."""
    return spread(table(spark, sf_dir, "documents"), PARTS, "doc_id")


def articles(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """The articles, with ``relevant`` only if ``labelled``: its join is not free."""
    docs = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 20
    types = (
        F.when(m < 3, "Case Reports;Journal Article;")
        .when(m < 6, "Clinical Trial, Phase II;")
        .when(m < 12, "Systematic Review;")
        .otherwise("Journal Article;")
    )
    if labelled:
        labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("relevant"))
        docs = docs.join(labels, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("article_id"),
        F.concat(F.lit(URL_PREFIX), F.col("doc_id").cast("string"), F.lit("/")).alias("url"),
        F.expr("date_add(date'2019-10-01', cast(doc_id % 365 as int))").alias("publication_date"),
        types.alias("publication_types"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.expr(r"substr(text, instr(concat(text, '\n'), '\n') + 1)").alias("abstract"),
        *(["relevant"] if labelled else []),
        "n_chars",
        "lang",
        "source",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_records(articles(spark, sf_dir, False), ["publication_types", "publication_date"], parts=PARTS)


def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of labelled articles with their folds."""
    rows = articles(spark, sf_dir).filter("relevant is not null")
    dealt = durable(stratified_folds(rows.select("article_id", F.col("relevant").alias("label"))), "folds")
    return build_records(rows, ["publication_types"], parts=PARTS).join(dealt, "article_id")


def scored(spark: SparkSession, sf_dir: str, with_length: bool = False) -> DataFrame:
    """``article_id, relevance`` by the fixed score; with the length term few ties."""
    text = F.col("_text")
    z = F.lit(SCORE_INTERCEPT)
    for word, weight in SCORE_WEIGHTS.items():
        z = z + F.when(text.contains(f" {word} "), F.lit(weight)).otherwise(0.0)
    if with_length:
        z = z + 0.1 * F.log(F.col("n_chars").cast("double"))
    docs = texts(spark, sf_dir).select("doc_id", "n_chars", padded_text(tokenize(F.col("text"))).alias("_text"))
    return docs.select(F.col("doc_id").alias("article_id"), F.round(1 / (1 + F.exp(-z)), 6).alias("relevance"))


def scores(spark: SparkSession, sf_dir: str, with_length: bool = False) -> DataFrame:
    """``article_id, fold, label, relevance`` of the labelled documents, stored once
    so that several passes do not tokenise the texts again."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("article_id"), F.col("toxic").alias("label")
    )
    folds = stratified_folds(labels)
    joined = scored(spark, sf_dir, with_length).join(folds, "article_id")
    return durable(joined.select("article_id", "fold", "label", "relevance"), "scores")


# --- the same as SQL ------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in CLOSED_CLASS)
_IRREGULAR = " ".join(f"when '{a}' then '{b}'" for a, b in IRREGULAR_FORMS.items())


def sql_tokens(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def sql_filtered(text: str) -> str:
    return (
        f"list_filter({sql_tokens(text)}, lambda t: translate(t, '0123456789_', '') <> '' and t not in ({_STOP}))"
    )


def sql_rules() -> str:
    """The suffix rules for a token ``t``."""
    return (
        "case when ends_with(t, 'ies') and length(t) > 4 then left(t, length(t) - 3) || 'y' "
        "when regexp_matches(t, '(ss|sh|ch|x|z)es$') and length(t) > 4 then left(t, length(t) - 2) "
        "when ends_with(t, 's') and not regexp_matches(t, '(ss|us|is)$') and length(t) > 3 then left(t, length(t) - 1) "
        "when ends_with(t, 'ing') and length(t) > 5 then left(t, length(t) - 3) "
        "when ends_with(t, 'ed') and length(t) > 4 then left(t, length(t) - 2) else t end"
    )


def sql_lemmas(text: str) -> str:
    return f"list_transform({sql_filtered(text)}, lambda t: case t {_IRREGULAR} else {sql_rules()} end)"


SQL_ARTICLES = f"""
articles as (
  select d.doc_id as article_id,
         concat('{URL_PREFIX}', d.doc_id, '/') as url,
         cast(date '2019-10-01' + cast(d.doc_id % 365 as int) as date) as publication_date,
         case when d.doc_id % 20 < 3 then 'Case Reports;Journal Article;'
              when d.doc_id % 20 < 6 then 'Clinical Trial, Phase II;'
              when d.doc_id % 20 < 12 then 'Systematic Review;'
              else 'Journal Article;' end as publication_types,
         split_part(d.text, chr(10), 1) as title,
         substr(d.text, strpos(concat(d.text, chr(10)), chr(10)) + 1) as abstract,
         l.toxic as relevant, d.n_chars, d.lang, d.source
  from documents d left join labels l on d.doc_id = l.doc_id)"""

SQL_RECORDS = (
    SQL_ARTICLES
    + f""",
records as (
  select article_id, publication_types, publication_date, relevant,
         list_concat(list_transform({sql_lemmas('title')}, lambda w: 'title_' || w), {sql_lemmas('abstract')}) as tokens
  from articles)"""
)

SQL_FOLDS = """
folds as (
  select doc_id as article_id, toxic as label,
         cast((row_number() over (partition by toxic order by md5(concat('142:', doc_id)), doc_id) - 1
               + case when toxic = 1 then (select count(*) from labels where toxic = 0) else 0 end) % 5 as int) as fold
  from labels)"""

_TERMS = " ".join(
    f"+ case when list_contains({{tokens}}, '{w}') then {c} else 0 end" for w, c in SCORE_WEIGHTS.items()
)


def sql_scored(with_length: bool = False) -> str:
    length = " + 0.1 * ln(cast(n_chars as double))" if with_length else ""
    z = f"cast({SCORE_INTERCEPT} as double) {_TERMS.format(tokens='toks')}{length}"
    return f"""
scored as (
  select doc_id as article_id, round(1 / (1 + exp(-({z}))), 6) as relevance
  from (select doc_id, n_chars, {sql_tokens('text')} as toks from documents))"""


def sql_scores(with_length: bool = False) -> str:
    return (
        SQL_FOLDS
        + ","
        + sql_scored(with_length)
        + """,
scores as (
  select f.article_id, f.fold, f.label, s.relevance from folds f join scored s using (article_id))"""
    )
