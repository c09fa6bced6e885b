"""Cleaning, checks, temporal split and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.functions import text as fn
from citesift.operators import articles as ops
from citesift.registry import views

PREFIXES = ("corrigendum", "the ", "la ")


def _joined(spark, sf_dir, tokens) -> DataFrame:
    """Tokens of the whole document text, as one comparable string."""
    docs = views.texts(spark, sf_dir).select("doc_id", tokens.alias("_t"))
    return docs.select("doc_id", F.size("_t").cast("long").alias("n_tokens"), F.array_join("_t", " ").alias("tokens"))


def clean_text(spark, sf_dir) -> DataFrame:
    return ops.clean_text(views.articles(spark, sf_dir, False)).select("article_id", "title", "abstract")


def exclude(spark, sf_dir) -> DataFrame:
    return ops.exclude(views.articles(spark, sf_dir, False), PREFIXES).select("article_id", "title")


def check_unique(spark, sf_dir) -> DataFrame:
    return ops.check_unique(views.articles(spark, sf_dir, False), ("url", "title", "abstract"))


def temporal_split(spark, sf_dir) -> DataFrame:
    old, new = ops.temporal_split(views.articles(spark, sf_dir, False))
    return (
        old.select("article_id", "publication_date", F.lit("old").alias("part"))
        .unionByName(new.select("article_id", "publication_date", F.lit("new").alias("part")))
    )


def preview_pairs(spark, sf_dir) -> DataFrame:
    return ops.preview_pairs(views.articles(spark, sf_dir, False), views.records(spark, sf_dir))


def tokenize(spark, sf_dir) -> DataFrame:
    return _joined(spark, sf_dir, fn.tokenize(F.col("text")))


def filter_tokens(spark, sf_dir) -> DataFrame:
    return _joined(spark, sf_dir, fn.filter_tokens(fn.tokenize(F.col("text"))))


def lemmatize(spark, sf_dir) -> DataFrame:
    return _joined(spark, sf_dir, fn.lemmas(F.col("text")))


def prefix_title(spark, sf_dir) -> DataFrame:
    rows = views.articles(spark, sf_dir, False)
    tokens = fn.prefix_title(fn.lemmas(F.col("title")))
    return rows.select("article_id", F.array_join(tokens, " ").alias("title_tokens"))


def build_records(spark, sf_dir) -> DataFrame:
    return views.records(spark, sf_dir).select(
        "article_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("record")
    )


def lexicon_records(spark, sf_dir) -> DataFrame:
    """Records by a lexicon as large as the vocabulary of the German documents: first four letters."""
    docs = views.texts(spark, sf_dir).filter("lang = 'de'")
    forms = docs.select(F.explode(F.array_distinct(fn.tokenize(F.col("text")))).alias("form")).distinct()
    lexicon = forms.select("form", F.substring("form", 1, 4).alias("lemma"))
    records = ops.build_records(views.articles(spark, sf_dir, False), lexicon=lexicon, parts=views.PARTS)
    return records.select(
        "article_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("record")
    )


QUERIES = {
    "clean_text": clean_text,
    "exclude": exclude,
    "check_unique": check_unique,
    "temporal_split": temporal_split,
    "preview_pairs": preview_pairs,
    "tokenize": tokenize,
    "filter_tokens": filter_tokens,
    "lemmatize": lemmatize,
    "prefix_title": prefix_title,
    "build_records": build_records,
    "lexicon_records": lexicon_records,
}


def _token_sql(expression: str) -> str:
    return f"""select doc_id, len(t) as n_tokens, array_to_string(t, ' ') as tokens
from (select doc_id, {expression} as t from documents)"""


def _unique_sql(column: str) -> str:
    return f"""select '{column}' as checked, count(*) as n_rows, count(distinct {column}) as n_distinct,
  count(*) = count(distinct {column}) as is_unique from articles"""


ORACLE = {
    "clean_text": f"""with {views.SQL_ARTICLES}
select article_id, replace(replace(title, '[', ''), ']', '') as title, replace(abstract, chr(10), ' ') as abstract
from articles""",
    "exclude": f"""with {views.SQL_ARTICLES} select article_id, title from articles
where not ({" or ".join(f"starts_with(lower(title), '{p}')" for p in PREFIXES)})""",
    "check_unique": f"with {views.SQL_ARTICLES} "
    + " union all ".join(_unique_sql(c) for c in ("url", "title", "abstract")),
    "temporal_split": f"""with {views.SQL_ARTICLES}
select article_id, publication_date, case when publication_date < date '2020-04-17' then 'old' else 'new' end as part
from articles""",
    "preview_pairs": f"""with {views.SQL_RECORDS}
select article_id, left(a.title, 40) as title, left(array_to_string(r.tokens, ' '), 40) as record
from articles a join records r using (article_id) order by article_id limit 10""",
    "tokenize": _token_sql(views.sql_tokens("text")),
    "filter_tokens": _token_sql(views.sql_filtered("text")),
    "lemmatize": _token_sql(views.sql_lemmas("text")),
    "prefix_title": f"""with {views.SQL_ARTICLES}
select article_id, array_to_string(list_transform({views.sql_lemmas('title')}, lambda w: 'title_' || w), ' ')
  as title_tokens from articles""",
    "build_records": f"""with {views.SQL_RECORDS}
select article_id, len(tokens) as n_tokens, array_to_string(tokens, ' ') as record from records""",
    "lexicon_records": f"""with {views.SQL_ARTICLES},
lexicon as (select distinct unnest({views.sql_tokens("text")}) as form from documents where lang = 'de'),
parts as (
  select article_id, 0 as part, {views.sql_filtered("title")} as ts from articles
  union all select article_id, 1, {views.sql_filtered("abstract")} from articles),
each as (select article_id, part, unnest(range(len(ts))) as p, unnest(ts) as t from parts),
found as (
  select article_id, part, p, case when part = 0 then 'title_' else '' end ||
    case when l.form is not null then left(l.form, 4) else {views.sql_rules()} end as lemma
  from each left join lexicon l on l.form = each.t)
select article_id, count(lemma) as n_tokens, coalesce(string_agg(lemma, ' ' order by part, p), '') as record
from articles left join found using (article_id) group by article_id""",
}
