"""Class-weighted L1 logistic regression: fit, tune, score, inspect."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citesift.operators import path
from citesift.operators.folds import balanced_weight, kfold
from citesift.session import durable

DEFAULT_C = 0.03
# The even grid of the inner search.
GRID_START, GRID_STOP, GRID_POINTS = 0.01, 1.0, 200
SELECTION_THRESHOLD = 1e-5
# Residual up to which the fits of a search are worked out; those that are kept, to ``path.TOLERANCE``.
SEARCHED = 1e-3


def even_grid(points: int = GRID_POINTS) -> list[float]:
    step = (GRID_STOP - GRID_START) / (points - 1) if points > 1 else 0.0
    return [GRID_START + i * step for i in range(points)]


@dataclass(frozen=True)
class L1Model:
    coefficients: list[float]
    intercept: float
    c: float

    def weights(self) -> Column:
        return F.lit(list(self.coefficients)).cast("array<double>")


def probability(features: Column, weights: Column, intercept: Column) -> Column:
    products = F.zip_with(features, weights, lambda x, w: x * w)
    margin = F.aggregate(products, F.lit(0.0), lambda a, b: a + b) + intercept
    return 1 / (1 + F.exp(-margin))


def collapse(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Equal feature rows of one class as one row with their number ``n``.

    Exact, since the loss is a sum over rows. Binary features leave few patterns,
    and all later passes run over patterns instead of documents.
    """
    return rows.groupBy(*by, "features", "label").agg(F.count("*").alias("n"))


def fit_l1_logistic(train: DataFrame, c: float = DEFAULT_C, tasks: int | None = None) -> L1Model:
    """Minimise ``|coefficients, intercept|_1 + c * sum(weight * loss)``.

    ``train`` holds ``features``, ``label`` and optionally ``n``, the times a row
    counts; classes are balanced, and the intercept is penalised like any coefficient.
    ``tasks`` is the number of parts the rows are read in. The fit is optimal to a
    residual of ``path.TOLERANCE``, see ``optimality``.
    """
    return _fits(train, F.lit(1), 1, {0: c}, tasks)[0]


def _fits(rows: DataFrame, part: Column, parts: int, c: dict[int, float], tasks: int | None) -> dict[int, L1Model]:
    """For every number in ``c`` the model of the rows whose ``part`` it is not."""
    count = F.col("n") if "n" in rows.columns else F.lit(1)
    chosen = rows.select(
        F.lit(0).alias("outer"), part.cast("int").alias("inner"), "features", "label", count.cast("long").alias("n")
    )
    data = path.blocks(chosen, parts, tasks)
    grid = sorted(set(c.values()))
    try:
        found = path.regularisation_path(data, grid)
    finally:
        data.rows.unpersist()
    weights = {k: found[0, k][grid.index(v)].tolist() if (0, k) in found else [0.0] for k, v in c.items()}
    return {k: L1Model(w[:-1], w[-1], c[k]) for k, w in weights.items()}


def score(df: DataFrame, model: L1Model) -> DataFrame:
    """Add ``relevance``, the probability of class 1."""
    return df.withColumn("relevance", probability(F.col("features"), model.weights(), F.lit(model.intercept)))


def score_by_fold(df: DataFrame, models: dict[int, L1Model]) -> DataFrame:
    """Score every row by the model of its own fold, in one pass."""
    weights = F.lit(None).cast("array<double>")
    intercept = F.lit(None).cast("double")
    for fold, model in models.items():
        here = F.col("fold") == fold
        weights = F.when(here, model.weights()).otherwise(weights)
        intercept = F.when(here, F.lit(model.intercept)).otherwise(intercept)
    return df.withColumn("relevance", probability(F.col("features"), weights, intercept))


def run_all(tasks: Iterable, job: Callable, threads: int) -> list:
    """Independent fits, submitted side by side so small jobs share the executors."""
    with ThreadPool(threads) as pool:
        return pool.map(job, list(tasks), chunksize=1)


def fit_folds(rows: DataFrame, k: int, c: dict[int, float], tasks: int | None = None) -> dict[int, L1Model]:
    """For every fold in ``c``, the model of all other folds' rows at its strength; ``k`` folds in all.

    All fits go through the passes of one path, over rows that are there once.
    """
    return _fits(rows, F.col("fold"), k, c, tasks)


def grid_search_recall(
    rows: DataFrame,
    folds: Sequence[int],
    grid: Sequence[float] | None = None,
    inner_k: int = 3,
    seed: int = 142,
    compact: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """``fold, c, recall``: mean recall at 0.5 over the inner folds, per outer fold.

    ``rows`` holds ``article_id, fold, label, features``. Every row joins the training
    set of each fold but its own, and inner folds are dealt out within each. All fits of
    all folds go through the passes of one screened path. ``compact`` collapses equal
    rows first, which pays for binary features; ``tasks`` is the number of parts the
    training rows are read in.
    """
    grid = list(grid or even_grid())
    members = rows.withColumn("outer", F.explode(F.array(*[F.lit(f) for f in folds]))).filter(
        F.col("outer") != F.col("fold")
    )
    inner = kfold(members, inner_k, seed, group=("outer",), name="inner")
    chosen = collapse(inner, ["outer", "inner"]) if compact else inner.select(
        "outer", "inner", "features", "label", F.lit(1).cast("long").alias("n")
    )
    data = path.blocks(durable(chosen, "patterns"), inner_k, tasks)
    try:
        hits = path.held_out_hits(data, path.regularisation_path(data, grid, tolerance=SEARCHED))
    finally:
        data.rows.unpersist()
    # One row per fold and value of C.
    found = []
    for outer in sorted({o for o, _ in hits}):
        parts = [hits[outer, held] for held in range(inner_k) if (outer, held) in hits]
        mean = sum(h / n if n else 0 * h for h, n in parts) / inner_k
        found += [(outer, c, float(r)) for c, r in zip(grid, mean)]
    return rows.sparkSession.createDataFrame(found, "fold int, c double, recall double")


def optimality(rows: DataFrame, models: dict[int, L1Model], names: Sequence[str]) -> DataFrame:
    """``fold, feature, documents, residual``: how far each coefficient is from its optimality condition.

    A fit is optimal if the gradient of the weighted loss is ``-sign(w) / c`` where a
    coefficient is not zero, and at most ``1 / c`` where it is. The residual is what is
    missing, as a share of ``1 / c``; it needs no other solver. ``rows`` hold ``fold, features,
    label`` and optionally ``n``; each fold's model is held against all other folds.
    ``documents`` counts training rows with the feature, ``(intercept)`` is the last one.
    """
    count = F.col("n") if "n" in rows.columns else F.lit(1).cast("long")
    counted = rows.groupBy("fold", "label").agg(F.sum(count).alias("n")).collect()
    outer = F.col("outer")
    weight = weights = intercept = F.lit(None)
    for fold, fitted in models.items():
        sizes: dict[int, int] = {}
        for r in counted:
            if r["fold"] != fold:
                sizes[r["label"]] = sizes.get(r["label"], 0) + r["n"]
        here = outer == fold
        weight = F.when(here, balanced_weight(sizes)).otherwise(weight)
        weights = F.when(here, fitted.weights()).otherwise(weights)
        intercept = F.when(here, F.lit(fitted.intercept)).otherwise(intercept)
    members = rows.withColumn("outer", F.explode(F.lit(sorted(models)))).filter("outer <> fold")
    error = (probability(F.col("features"), weights, intercept) - F.col("label")) * weight * count
    extended = F.concat("features", F.array(F.lit(1.0)))
    pulls = members.withColumns({"_e": error, "_n": count}).select(
        "outer",
        array_to_vector(F.transform(extended, lambda x: x * F.col("_e"))).alias("_g"),
        array_to_vector(F.transform(extended, lambda x: F.when(x != 0, F.col("_n")).otherwise(0).cast("double"))).alias("_d"),
    )
    total = Summarizer.metrics("sum")
    sums = pulls.groupBy("outer").agg(
        vector_to_array(total.summary(F.col("_g"))["sum"]).alias("g"),
        vector_to_array(total.summary(F.col("_d"))["sum"]).alias("d"),
    )
    fits = [
        (fold, i, name, w, 1.0 / m.c)
        for fold, m in models.items()
        for i, (name, w) in enumerate(zip([*names, "(intercept)"], [*m.coefficients, m.intercept]))
    ]
    # One row per fold and feature.
    fitted_rows = rows.sparkSession.createDataFrame(fits, "fold int, i int, feature string, w double, penalty double")
    pulled = sums.select(F.col("outer").alias("fold"), F.posexplode(F.arrays_zip("g", "d")).alias("i", "s"))
    g, penalty = F.col("s.g"), F.col("penalty")
    missing = F.when(F.col("w") == 0, F.greatest(F.abs(g) - penalty, F.lit(0.0))).otherwise(F.abs(g + F.signum("w") * penalty))
    return pulled.join(F.broadcast(fitted_rows), ["fold", "i"]).select(
        "fold", "feature", F.round("s.d").cast("long").alias("documents"), (missing / penalty).alias("residual")
    )


def best_c(search: DataFrame) -> DataFrame:
    """``fold, c``: greatest recall, the smallest ``c`` among equals."""
    rank = F.row_number().over(Window.partitionBy("fold").orderBy(F.desc(F.round("recall", 12)), "c"))
    return search.withColumn("_r", rank).filter("_r = 1").select("fold", "c", "recall")


def coefficients(spark: SparkSession, models: dict[int, L1Model], names: dict[int, list[str]]) -> DataFrame:
    """``fold, feature, coefficient``; one row per fold and feature."""
    rows = [(f, n, w) for f, m in models.items() for n, w in zip(names[f], m.coefficients)]
    return spark.createDataFrame(rows, "fold int, feature string, coefficient double")


def selected_features(table: DataFrame) -> DataFrame:
    return table.filter(F.abs("coefficient") >= SELECTION_THRESHOLD)


def support(table: DataFrame) -> DataFrame:
    """``fold, support``: the number of selected features, also where it is 0."""
    return table.groupBy("fold").agg(
        F.count_if(F.abs("coefficient") >= SELECTION_THRESHOLD).alias("support")
    )


def feature_importance(table: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` greatest signed coefficients of every fold."""
    rank = F.row_number().over(Window.partitionBy("fold").orderBy(F.col("coefficient").desc(), "feature"))
    return table.withColumn("rank", rank).filter(F.col("rank") <= n)


def out_of_fold_scores(scored: Sequence[DataFrame]) -> DataFrame:
    """The test scores of all folds: each document once, by a model that never saw it."""
    columns = ["article_id", "fold", "label", "relevance"]
    result = scored[0].select(*columns)
    for part in scored[1:]:
        result = result.unionByName(part.select(*columns))
    return result
