"""Score new documents, and the tables of misclassified ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.operators import export, metrics, model
from citesift.operators.articles import build_records
from citesift.operators.feature_sets import feature_set
from citesift.operators.retrieval import Query
from citesift.session import durable
from citesift.sources.articles import write_ranked

ERROR_CUTOFF = 0.5


def score_new(
    old: DataFrame,
    new: DataFrame,
    queries: Sequence[Query],
    kind: str = "simple",
    c: float = model.DEFAULT_C,
    n_topics: int = 50,
    lda_iterations: int = 20,
    parts: int | None = None,
) -> DataFrame:
    """Fit on all labelled documents of ``old``, without tuning, and score every document of ``new``.

    The two are read apart, ``read_articles`` with a date range for each, so that neither
    pass goes over the other's files. ``new`` is read once, and its tokens are not stored.
    """
    train = old.filter("relevant is not null")
    records = durable(build_records(train, ["publication_types", F.col("relevant").alias("label")], parts=parts), "records")
    fitted = feature_set(kind, records, queries, n_topics, lda_iterations)
    rows = fitted.transform(records, ["label"])
    if kind == "simple":
        rows = model.collapse(rows)
    chosen = model.fit_l1_logistic(rows, c, parts)
    unseen = build_records(new, ["publication_types"], parts=parts)
    return model.score(fitted.transform(unseen, ["article_id"]), chosen).select("article_id", "relevance")


def error_tables(scores: DataFrame, articles: DataFrame, cutoff: float = ERROR_CUTOFF) -> dict[str, DataFrame]:
    """False negatives and false positives of the out-of-fold scores, ranked."""
    wrong = export.errors(metrics.classify(scores, cutoff))
    ranked = export.ranked_export(wrong, articles, ("kind",))
    return {
        name: ranked.filter(F.col("kind") == kind).drop("kind")
        for name, kind in (("false_negatives", "FN"), ("false_positives", "FP"))
    }


def save_tables(
    new_scores: DataFrame, new: DataFrame, scores: DataFrame, old: DataFrame, path: str, slices: int | None = None
) -> None:
    """Ranked tables of new and of misclassified articles under ``path``, each in ``slices`` files, see ``write_in_order``."""
    write_ranked(export.ranked_export(durable(new_scores, "scores"), new), f"{path}/new_articles", slices)
    for name, table in error_tables(scores, old).items():
        write_ranked(table, f"{path}/{name}", slices)
