"""Precision-recall and gain curves.

Every curve starts from one row per distinct score: equal scores are summed on
the map side first, then cumulated over range-partitioned slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.operators.ordering import attach, global_rank, running_sums
from citesift.session import durable


def score_levels(scores: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Per distinct score: rows ``n``, positives ``pos``, and both cumulated from
    the highest score down (``cum_n``, ``cum_pos``), with the group's ``all_n``,
    ``all_pos``. Stored: every curve and area reads it, some more than once."""
    levels = scores.groupBy(*by, "relevance").agg(
        F.count("*").alias("n"), F.sum("label").cast("long").alias("pos")
    )
    cumulated = running_sums(levels, [F.col("relevance").desc()], {"cum_n": "n", "cum_pos": "pos"}, by)
    totals = cumulated.groupBy(*by).agg(F.max("cum_n").alias("all_n"), F.max("cum_pos").alias("all_pos"))
    return durable(attach(cumulated, totals, by), "levels")


def pr_curve(levels: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """``threshold, precision, recall`` per distinct score, and the end point (1, 0)."""
    points = levels.select(
        *by,
        F.col("relevance").alias("threshold"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        F.try_divide("cum_pos", "all_pos").alias("recall"),
    )
    end = levels.groupBy(*by).agg(F.count("*").alias("_levels"))
    end = end.select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def pr_auc(levels: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Trapezoid area under precision over recall.

    The neighbour of a point follows from its own cumulated counts, so the area is
    a plain sum without looking at another row.
    """
    previous = F.when(F.col("cum_n") == F.col("n"), F.lit(1.0)).otherwise(
        F.try_divide(F.col("cum_pos") - F.col("pos"), F.col("cum_n") - F.col("n"))
    )
    precision = F.col("cum_pos") / F.col("cum_n")
    strip = F.try_divide("pos", "all_pos") * (precision + previous) / 2
    return levels.groupBy(*by).agg(F.sum(strip).alias("prauc"))


def pr_envelope(curve: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """The greatest precision of each recall level."""
    return curve.groupBy(*by, "recall").agg(F.max("precision").alias("precision"))


def rank_documents(scores: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """``rank`` by falling relevance; among equal scores relevant ones come first."""
    return global_rank(
        scores, [F.col("relevance").desc(), F.col("label").desc(), F.col("article_id").asc()], by
    )


def gain_curve(levels: DataFrame, by: Sequence[str] = ("fold",), chunk: int = 100_000) -> DataFrame:
    """``k, screened, recall`` for every number ``k`` of documents screened.

    Within a score the relevant documents come first, so a level's points follow
    from its counts. A level is expanded in two steps, first into chunk starts
    that are spread over the cluster, so no tie group is expanded by one task.
    """
    starts = levels.select(
        *by,
        "n",
        "pos",
        (F.col("cum_n") - F.col("n")).alias("_n0"),
        (F.col("cum_pos") - F.col("pos")).alias("_pos0"),
        "all_n",
        "all_pos",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(chunk).cast("long"))).alias("_from"),
    ).repartition(*by, "_n0", "_from")
    last = F.least(F.col("_from") + (chunk - 1), F.col("n"))
    steps = starts.withColumn("_j", F.explode(F.sequence(F.col("_from"), last)))
    found = F.col("_pos0") + F.least(F.col("_j"), F.col("pos"))
    return steps.select(
        *by,
        (F.col("_n0") + F.col("_j")).alias("k"),
        ((F.col("_n0") + F.col("_j")) / F.col("all_n")).alias("screened"),
        F.try_divide(found, F.col("all_pos")).alias("recall"),
    )


def step_points(gain: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """First and last ``x`` of each recall ``y``, with (0, 0) and (1, 1) added."""
    spans = gain.groupBy(*by, F.col("recall").alias("y")).agg(
        F.min("screened").alias("_first"), F.max("screened").alias("_last")
    )
    corners = spans.select(*by, F.explode(F.array("_first", "_last")).alias("x"), "y")
    ends = spans.groupBy(*by).agg(F.count("*").alias("_spans"))
    ends = ends.select(*by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("x")).withColumn("y", F.col("x"))
    return corners.unionByName(ends)


def screened_at_recall(levels: DataFrame, recall: float = 0.95, by: Sequence[str] = ("fold",)) -> DataFrame:
    """Share of documents to screen until the recall is reached, and work saved.

    Only the level where the target falls is looked at; the count of relevant
    documents needed is the smallest ``t`` with ``t / all_pos >= recall``.
    """
    guess = F.ceil(F.lit(recall) * F.col("all_pos"))
    needed = (
        F.when((guess - 1) / F.col("all_pos") >= recall, guess - 1)
        .when(guess / F.col("all_pos") < recall, guess + 1)
        .otherwise(guess)
    )
    before = F.col("cum_pos") - F.col("pos")
    k = F.col("cum_n") - F.col("n") + needed - before
    reached = (F.col("cum_pos") >= needed) & (before < needed) & (F.col("all_pos") > 0)
    return (
        levels.filter(reached)
        .groupBy(*by)
        .agg(F.min(k / F.col("all_n")).alias("screened"))
        .withColumn("work_saved", F.lit(recall) - F.col("screened"))
    )


def select_threshold(levels: DataFrame, recall: float = 0.95, by: Sequence[str] = ("fold",)) -> DataFrame:
    """The greatest score at or above which the recall is reached."""
    reached = F.try_divide("cum_pos", "all_pos") >= recall
    return levels.filter(reached).groupBy(*by).agg(F.max("relevance").alias("threshold"))
