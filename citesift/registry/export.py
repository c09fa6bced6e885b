"""Error analysis and ranked export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.operators import export, metrics
from citesift.operators.articles import CUTOFF_DATE, temporal_split
from citesift.plans import update
from citesift.plans.build import prepare
from citesift.registry import views
from citesift.registry.modelling import MODEL_QUERIES
from citesift.session import durable, scratch_path
from citesift.sources.articles import read_articles, write_articles, write_ranked


def _wrong(spark, sf_dir) -> DataFrame:
    pred = metrics.classify(views.scores(spark, sf_dir, True), 0.4)
    return export.misclassified(pred, views.articles(spark, sf_dir))


def misclassified(spark, sf_dir) -> DataFrame:
    return _wrong(spark, sf_dir).select("article_id", "kind", "relevance", "url", "title")


def _new(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Scores and articles from the cut-off date on."""
    _, new = temporal_split(views.articles(spark, sf_dir))
    return views.scored(spark, sf_dir, True).join(new.select("article_id"), "article_id", "left_semi"), new


def _new_rows(spark, sf_dir) -> DataFrame:
    scores, new = _new(spark, sf_dir)
    return export.export_rows(scores.join(new, "article_id"))


def export_rows(spark, sf_dir) -> DataFrame:
    return _new_rows(spark, sf_dir)


def ranked_export(spark, sf_dir) -> DataFrame:
    """The new articles, written as ranked JSON rows and read back."""
    path = scratch_path(spark, "new-articles")
    scores, new = _new(spark, sf_dir)
    ranked = export.ranked_export(durable(scores, "scores"), new)
    write_ranked(ranked, path)
    return spark.read.schema(ranked.schema).json(path)


def error_tables(spark, sf_dir) -> DataFrame:
    scores = views.scores(spark, sf_dir, True)
    tables = update.error_tables(scores, views.articles(spark, sf_dir), 0.4)
    named = [t.select(F.lit(name).alias("table_name"), "rank", "article_id", "relevance") for name, t in tables.items()]
    return named[0].unionByName(named[1])


def _scored_new(spark, sf_dir) -> DataFrame:
    """The articles stored, old and new ones read by their dates, the new ones scored."""
    path = scratch_path(spark, "articles")
    write_articles(views.articles(spark, sf_dir), path)
    old = prepare(read_articles(spark, path, before=CUTOFF_DATE))
    new = prepare(read_articles(spark, path, since=CUTOFF_DATE, undated=True))
    return update.score_new(old, new, MODEL_QUERIES, c=1.0, parts=views.PARTS)


def new_scores(spark, sf_dir) -> DataFrame:
    return _scored_new(spark, sf_dir)


def score_new(spark, sf_dir) -> DataFrame:
    """Every article from the cut-off date on, and whether its score is a probability; the scores are ``new_scores``."""
    scored = (F.col("relevance") >= 0) & (F.col("relevance") <= 1)
    return _scored_new(spark, sf_dir).select("article_id", scored.alias("scored"))


def display_fields(spark, sf_dir) -> DataFrame:
    rows = export.display_fields(_new_rows(spark, sf_dir))
    return rows.select("article_id", "date", "title", "abstract", "link_text", "relevance")


def paginate(spark, sf_dir) -> DataFrame:
    scores, _ = _new(spark, sf_dir)
    return export.paginate(export.rank_scores(durable(scores, "scores"))).select("article_id", "rank", "page")


def page_count(spark, sf_dir) -> DataFrame:
    _, new = temporal_split(views.articles(spark, sf_dir))
    return export.page_count(new)


QUERIES = {
    "misclassified": misclassified,
    "export_rows": export_rows,
    "ranked_export": ranked_export,
    "error_tables": error_tables,
    "score_new": score_new,
    "new_scores": new_scores,
    "display_fields": display_fields,
    "paginate": paginate,
    "page_count": page_count,
}

_WRONG = f"""with {views.SQL_ARTICLES}, {views.sql_scores(True)},
wrong as (
  select s.article_id, case when s.label = 1 then 'FN' else 'FP' end as kind, s.relevance, a.url, a.title
  from scores s join articles a using (article_id) where s.label <> cast(s.relevance > 0.4 as int))"""


def _plain(column: str) -> str:
    return f"translate({column}, concat(chr(10), chr(39), chr(34)), '')"


_NEW = f"""with {views.SQL_ARTICLES}, {views.sql_scored(True)},
fresh as (
  select article_id, url, strftime(publication_date, '%d %B, %Y') as date, {_plain('title')} as title,
    {_plain('abstract')} as abstract, cast(round_even(relevance * 100, 0)::double / 100 as varchar) as relevance,
    relevance as score
  from articles a join scored s using (article_id) where publication_date >= date '2020-04-17')"""

ORACLE = {
    "misclassified": f"{_WRONG} select * from wrong",
    "export_rows": f"{_NEW} select * from fresh",
    "ranked_export": f"{_NEW} select *, row_number() over (order by score desc, article_id) as rank from fresh",
    "error_tables": f"""{_WRONG}
select case kind when 'FN' then 'false_negatives' else 'false_positives' end as table_name,
  row_number() over (partition by kind order by relevance desc, article_id) as rank, article_id,
  cast(round_even(relevance * 100, 0)::double / 100 as varchar) as relevance from wrong""",
    "display_fields": f"""{_NEW}
select article_id, regexp_replace(regexp_replace(date, '^0', ''), '^([0-9]+) ', '\\1. ') as date, title,
  case when length(abstract) > 150 then left(abstract, 150) || ' ..' else abstract end as abstract,
  'docs' as link_text, relevance from fresh""",
    "paginate": f"""{_NEW}
select article_id, rank, cast(ceil(rank / 10) as int) as page
from (select article_id, row_number() over (order by score desc, article_id) as rank from fresh)""",
    "page_count": f"""with {views.SQL_ARTICLES}
select cast(ceil(count(*) / 10) as int) as pages from articles where publication_date >= date '2020-04-17'""",
    "score_new": f"""with {views.SQL_ARTICLES}
select article_id, true as scored from articles where publication_date >= date '2020-04-17'""",
}
