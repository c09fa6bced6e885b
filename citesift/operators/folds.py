"""Cross-validation folds and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.operators.ordering import hash_rank


def stratified_folds(
    df: DataFrame, k: int = 5, seed: int = 142, label: str = "label", id_col: str = "article_id"
) -> DataFrame:
    """Add ``fold`` in ``0..k-1``: shuffled within each class, dealt out in turn.

    Dealing continues from one class to the next, so fold sizes also differ by at
    most one row overall.
    """
    ranked = hash_rank(df, seed, id_col, [label], "_rank")
    negatives = df.filter(F.col(label) == 0).agg(F.count("*").alias("n")).scalar()
    start = F.when(F.col(label) == 1, negatives).otherwise(0)
    return ranked.withColumn("fold", ((F.col("_rank") + start) % k).cast("int")).drop("_rank")


def kfold(
    df: DataFrame, k: int = 3, seed: int = 142, id_col: str = "article_id", group: tuple[str, ...] = (),
    name: str = "fold",
) -> DataFrame:
    """Add plain shuffled folds, within ``group`` if given."""
    ranked = hash_rank(df, seed, id_col, group, "_rank")
    return ranked.withColumn(name, (F.col("_rank") % k).cast("int")).drop("_rank")


def fold_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    """``fold, train_0, train_1, test_0, test_1``."""
    test = df.groupBy("fold").agg(
        F.count_if(F.col(label) == 0).alias("test_0"), F.count_if(F.col(label) == 1).alias("test_1")
    )
    # One row per fold.
    everything = Window.partitionBy()
    return test.select(
        "fold",
        (F.sum("test_0").over(everything) - F.col("test_0")).alias("train_0"),
        (F.sum("test_1").over(everything) - F.col("test_1")).alias("train_1"),
        "test_0",
        "test_1",
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``label, n, weight`` with the balanced weight ``rows / (classes * n)``."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # One row per class.
    everything = Window.partitionBy()
    rows, classes = F.sum("n").over(everything), F.count("*").over(everything)
    return counts.select(label, "n", (rows / (classes * F.col("n"))).alias("weight"))


def balanced_weight(sizes: dict[int, float], label: str = "label") -> Column:
    """The same weight as a column expression, from known class sizes."""
    rows, classes = sum(sizes.values()), len(sizes)
    weight = F.lit(None).cast("double")
    for value, n in sizes.items():
        weight = F.when(F.col(label) == value, F.lit(rows / (classes * n))).otherwise(weight)
    return weight
