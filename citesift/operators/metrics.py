"""Classification metrics, threshold choice, histograms and the fold report.

Scores are rows ``article_id, fold, label, relevance``. Functions take ``by``, the
grouping columns: ``("fold",)`` per fold, ``()`` for all folds together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.operators.ordering import attach

# Fixed value: the published cut-off.
CUTOFF = 0.26


def classify(scores: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``pred`` = 1 where the relevance is strictly above the cut-off."""
    return scores.withColumn("pred", (F.col("relevance") > F.lit(cutoff)).cast("int"))


def classify_from(scores: DataFrame, thresholds: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """``pred`` = 1 from the group's own ``threshold`` on, as ``select_threshold`` gives it, so its recall is kept.

    There is one threshold per group; in a group without one nothing is predicted.
    """
    chosen = thresholds.select(*by, "threshold")
    joined = scores.join(chosen, [*by], "left")
    pred = F.coalesce((F.col("relevance") >= F.col("threshold")).cast("int"), F.lit(0))
    return joined.withColumn("pred", pred).drop("threshold")


def confusion(pred: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    label, guess = F.col("label"), F.col("pred")
    return pred.groupBy(*by).agg(
        F.count_if((label == 0) & (guess == 0)).alias("tn"),
        F.count_if((label == 0) & (guess == 1)).alias("fp"),
        F.count_if((label == 1) & (guess == 0)).alias("fn"),
        F.count_if((label == 1) & (guess == 1)).alias("tp"),
    )


def cross_table(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Actual labels down, predictions across."""
    table = pred.groupBy(*by, "label").pivot("pred", [0, 1]).agg(F.count("label"))
    return table.na.fill(0, ["0", "1"]).withColumnsRenamed({"0": "pred_0", "1": "pred_1"})


def _precision() -> Column:
    return F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))


def precision_recall(matrix: DataFrame) -> DataFrame:
    """Null where nothing was predicted, or nothing was, relevant."""
    return matrix.withColumns({"precision": _precision(), "recall": _recall()})


def wss(matrix: DataFrame) -> DataFrame:
    """Work saved over sampling at the recall reached."""
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return matrix.withColumn("wss", (F.col("tn") + F.col("fn")) / n - (1 - _recall()))


def micro_average(matrix: DataFrame) -> DataFrame:
    """Precision and recall of the summed fold matrices."""
    summed = matrix.agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    return precision_recall(summed)


def score_histogram(
    scores: DataFrame,
    bins: int = 30,
    by: Sequence[str] = ("fold",),
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """``bin, lower, upper, n`` for every bin; the last bin includes its upper edge.

    Without ``bounds`` each group spans its own minimum to maximum. Equal scores
    are counted once before the range is joined on, so only distinct scores move.
    """
    counts = scores.groupBy(*by, "relevance").agg(F.count("*").alias("_n"))
    if bounds is None:
        lo, hi = F.min("relevance"), F.max("relevance")
        ranges = scores.groupBy(*by).agg(
            F.when(lo == hi, lo - 0.5).otherwise(lo).alias("_lo"),
            F.when(lo == hi, hi + 0.5).otherwise(hi).alias("_hi"),
        )
    else:
        ranges = (
            scores.groupBy(*by)
            .agg(F.count("*").alias("_rows"))
            .select(*by, F.lit(float(bounds[0])).alias("_lo"), F.lit(float(bounds[1])).alias("_hi"))
        )
    width = (F.col("_hi") - F.col("_lo")) / bins
    scaffold = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    joined = attach(counts, ranges, by)
    place = F.least(F.floor((F.col("relevance") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    filled = (
        joined.filter((F.col("relevance") >= F.col("_lo")) & (F.col("relevance") <= F.col("_hi")))
        .groupBy(*by, place.alias("bin"))
        .agg(F.sum("_n").alias("n"))
    )
    return scaffold.join(filled, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("lower"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


# The columns of the report.
REPORT_COLUMNS = (
    "fold", "train_0", "train_1", "test_0", "test_1", "param_C", "support",
    "recall", "precision", "prauc", "wss",
)


def fold_report(sizes: DataFrame, models: DataFrame, matrix: DataFrame, prauc: DataFrame) -> DataFrame:
    """One row per fold, unrounded; folds are numbered from 1.

    ``models`` holds ``fold, param_C, support``. All inputs have one row per fold.
    """
    metrics = wss(precision_recall(matrix))
    return (
        sizes.join(models, "fold")
        .join(metrics.select("fold", "recall", "precision", "wss"), "fold")
        .join(prauc.select("fold", "prauc"), "fold")
        .withColumn("fold", F.col("fold") + 1)
        .select(*REPORT_COLUMNS)
    )


def rounded_report(report: DataFrame, digits: int = 2) -> DataFrame:
    return report.withColumns(
        {c: F.round(c, digits) for c in ("param_C", "recall", "precision", "prauc", "wss")}
    )


def mean_std(report: DataFrame) -> DataFrame:
    """The ``Mean`` row as text: means, and population deviations in brackets."""

    def whole(name: str) -> Column:
        return F.format_string("%d", F.avg(name).cast("long")).alias(name)

    def spread(name: str) -> Column:
        return F.format_string("%.2f (%.2f)", F.avg(name), F.stddev_pop(name)).alias(name)

    support = F.format_string(
        "%d (%d)", F.avg("support").cast("long"), F.stddev_pop("support").cast("long")
    )
    return report.agg(
        F.lit("Mean").alias("fold"),
        *[whole(c) for c in ("train_0", "train_1", "test_0", "test_1")],
        F.format_string("%.2f", F.avg("param_C")).alias("param_C"),
        support.alias("support"),
        *[spread(c) for c in ("recall", "precision", "prauc", "wss")],
    )


def report_table(report: DataFrame) -> DataFrame:
    """The rounded fold rows followed by the ``Mean`` row, all as text."""
    rows = rounded_report(report)
    return rows.select(*[F.col(c).cast("string") for c in REPORT_COLUMNS]).unionByName(mean_std(report))
