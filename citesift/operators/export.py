"""Error tables, ranked export and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.operators.ordering import global_rank


def errors(pred: DataFrame) -> DataFrame:
    """``article_id, relevance, kind``: the wrong predictions, FN or FP."""
    kind = F.when(F.col("label") == 1, "FN").otherwise("FP")
    return pred.filter(F.col("label") != F.col("pred")).select("article_id", "relevance", kind.alias("kind"))


def misclassified(pred: DataFrame, articles: DataFrame) -> DataFrame:
    """Wrong predictions with ``kind`` FN or FP, joined to their articles."""
    return errors(pred).join(articles, "article_id")


def _plain(column: str):
    return F.translate(F.coalesce(column, F.lit("")), "\n'\"", "")


def export_rows(scored: DataFrame) -> DataFrame:
    """``url, date, title, abstract, relevance`` as text, relevance with two decimals.

    Rounds half to even. ``article_id``, and ``rank`` and ``kind`` where present, stay;
    ``score`` keeps the unrounded number to order by.
    """
    return scored.select(
        "article_id",
        *[c for c in ("rank", "kind") if c in scored.columns],
        "url",
        F.date_format("publication_date", "dd MMMM, yyyy").alias("date"),
        _plain("title").alias("title"),
        _plain("abstract").alias("abstract"),
        (F.rint(F.col("relevance") * 100) / 100).cast("string").alias("relevance"),
        F.col("relevance").alias("score"),
    )


def rank_scores(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rank`` by falling relevance; it replaces the order of a file."""
    return global_rank(scores, [F.col("relevance").desc(), F.col("article_id").asc()], by)


def ranked_export(scores: DataFrame, articles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Export rows with their rank. Ids and scores are ranked before the texts are
    joined, so no text is sampled, sorted or stored for it."""
    narrow = scores.select("article_id", "relevance", *by)
    return export_rows(rank_scores(narrow, by).join(articles, "article_id"))


def display_fields(rows: DataFrame, width: int = 150) -> DataFrame:
    """What the collapsed table row shows: date without leading zero and with a dot
    after the day, shortened abstract, link text up to the first dot."""
    day_first = F.regexp_replace(F.trim("date"), "^0", "")
    date = F.regexp_replace(day_first, "^([0-9]+) ", r"$1. ")
    cut = F.concat(F.substring("abstract", 1, width), F.lit(" .."))
    site = F.split_part("url", F.lit("."), F.lit(1))
    return rows.withColumns(
        {
            "date": date,
            "abstract": F.when(F.length("abstract") > width, cut).otherwise(F.col("abstract")),
            "link_text": F.substring(site, F.lit(len("https://") + 1), F.length(site)),
        }
    )


def paginate(ranked: DataFrame, rows_per_page: int = 10) -> DataFrame:
    """Add ``page`` from the rank. One page is then the range filter of ``page_of``."""
    return ranked.withColumn("page", F.ceil(F.col("rank") / rows_per_page).cast("int"))


def page_of(ranked: DataFrame, page: int, rows_per_page: int = 10) -> DataFrame:
    """Rows of one page by a range of ranks, which reaches the scan of a stored table."""
    first = (page - 1) * rows_per_page
    return ranked.filter((F.col("rank") > first) & (F.col("rank") <= first + rows_per_page))


def page_count(ranked: DataFrame, rows_per_page: int = 10) -> DataFrame:
    return ranked.agg(F.ceil(F.count("*") / rows_per_page).cast("int").alias("pages"))
