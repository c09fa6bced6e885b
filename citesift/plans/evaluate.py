"""Cross-validated evaluation of the screening model."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.operators import curves, folds, metrics, model
from citesift.operators.articles import build_records
from citesift.operators.feature_sets import FeatureModel, feature_set, fitted_features
from citesift.operators.retrieval import Query
from citesift.operators.topics import Topics, topic_coherence
from citesift.session import durable, exists, spread
from citesift.sources.articles import write_curves
from citesift.sources.models import load_model, save_model


@dataclass
class Settings:
    """``grid`` = None fits ``c`` without a search; ``model.even_grid()`` is the full one.

    ``coherence`` is that of the topic models of every fold, which the report does not need.
    ``parts`` is the number of parts texts, tokens and features are worked on in, for
    input that lies in few files, see ``spread``; ``tasks`` is the number of parts training
    rows are read in, 0 for that of the cores.
    """

    kind: str = "simple"
    k: int = 5
    seed: int = 142
    inner_k: int = 3
    c: float = model.DEFAULT_C
    grid: Sequence[float] | None = None
    cutoff: float = metrics.CUTOFF
    n_topics: int = 50
    lda_iterations: int = 20
    passes: float = 10.0
    no_below: int = 20
    keep_n: int = 100_000
    topic_concentration: float | None = None
    coherence: bool = True
    threads: int = 4
    parts: int | None = None
    tasks: int | None = None


@dataclass
class CrossValidation:
    """Scores of every document by a model that never saw it, and those models.

    ``coherence`` and ``topic_terms`` are those of the topic models, by fold, if there are any.
    """

    scores: DataFrame
    coefficients: DataFrame
    param_c: dict[int, float]
    models: dict[int, model.L1Model] = field(default_factory=dict)
    features: dict[int, FeatureModel] = field(default_factory=dict)
    topic_terms: DataFrame | None = None
    coherence: DataFrame | None = None


KEEP = ("article_id", "fold", "label")
# Words of a topic that its coherence is measured on.
TOP_WORDS = 20


def cross_validate(
    articles: DataFrame, queries: Sequence[Query], settings: Settings = Settings(), store: str | None = None
) -> CrossValidation:
    """Articles need ``article_id, title, abstract, publication_types, relevant``.

    Texts are turned into tokens once and stored; all folds read the tokens. With
    ``store`` every fold that is done keeps its models, topics, coherence and scores
    under that path, and a run that finds a fold there reads it instead of fitting it
    again. Other settings or queries than those of the store are refused.
    """
    spark = articles.sparkSession
    if store:
        _check_settings(spark, queries, settings, store)
    done = [k for k in range(settings.k) if store and exists(spark, f"{store}/fold={k}/done")]
    missing = [k for k in range(settings.k) if k not in done]
    fitted: dict[int, Fold] = {}
    if missing:
        records = _records(articles, settings, store)
        run = _simple if settings.kind == "simple" else _full
        fitted = run(records, queries, settings, missing, store)
    fitted |= {k: _stored(spark, f"{store}/fold={k}", k) for k in done}
    return _together(spark, fitted)


@dataclass
class Fold:
    """What one fold yields; ``topics`` and ``coherence`` for the full feature set only."""

    features: FeatureModel
    model: model.L1Model
    scores: DataFrame
    topics: DataFrame | None = None
    coherence: DataFrame | None = None


def _check_settings(spark: SparkSession, queries: Sequence[Query], s: Settings, store: str) -> None:
    # How a run is spread over tasks does not change what it yields.
    chosen = {k: v for k, v in asdict(s).items() if k not in ("threads", "parts", "tasks", "cutoff")}
    text = json.dumps([chosen, [[q.name, q.groups] for q in queries]], sort_keys=True, default=list)
    path = f"{store}/settings"
    if not exists(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(path)
    elif spark.read.text(path).first()["value"] != text:
        raise ValueError(f"{store} holds an evaluation with other settings or queries")


def _records(articles: DataFrame, s: Settings, store: str | None) -> DataFrame:
    """Tokens with labels and folds. Folds are dealt over ids and labels alone, and joined once."""
    spark = articles.sparkSession
    path = f"{store}/records" if store else None
    if path and exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    labelled = articles.filter("relevant is not null")
    narrow = labelled.select("article_id", F.col("relevant").alias("label"))
    dealt = durable(folds.stratified_folds(narrow, s.k, s.seed), "folds")
    rows = build_records(labelled, ["publication_types"], parts=s.parts).join(dealt, "article_id")
    # The size the join is given by the optimizer would put all tokens into few parts.
    rows = spread(rows, s.parts, "article_id")
    if path is None:
        return durable(rows, "records")
    rows.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _chosen_c(features: DataFrame, numbers: Sequence[int], s: Settings) -> dict[int, float]:
    if s.grid is None:
        return dict.fromkeys(numbers, s.c)
    # Scaled features hardly ever repeat a row.
    search = model.grid_search_recall(features, numbers, s.grid, s.inner_k, s.seed, s.kind == "simple", s.tasks)
    # One row per fold.
    return {r["fold"]: r["c"] for r in model.best_c(search).collect()}


def _finished(fold: Fold, k: int, store: str | None) -> Fold:
    """Keep what the fold yielded; its mark is written last."""
    if store is None:
        return replace(fold, scores=durable(fold.scores, "scores"))
    spark = fold.scores.sparkSession
    path = f"{store}/fold={k}"
    save_model(spark, fold.features, fold.model, f"{path}/model")
    fold.scores.write.mode("overwrite").parquet(f"{path}/scores")
    for name, table in (("topics", fold.topics), ("coherence", fold.coherence)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return _stored(spark, path, k)


def _stored(spark: SparkSession, path: str, k: int) -> Fold:
    features, fitted = load_model(spark, f"{path}/model")
    tables = [spark.read.parquet(f"{path}/{n}") if exists(spark, f"{path}/{n}") else None for n in ("topics", "coherence")]
    return Fold(features, fitted, spark.read.parquet(f"{path}/scores"), *tables)


def _simple(
    records: DataFrame, queries: Sequence[Query], s: Settings, numbers: list[int], store: str | None
) -> dict[int, Fold]:
    """The vocabulary comes from the queries, so all folds share one feature table."""
    fitted = feature_set("simple", records, queries)
    features = durable(fitted.transform(records, KEEP), "features")
    chosen = _chosen_c(features, numbers, s)
    models = model.fit_folds(model.collapse(features, ["fold"]), s.k, chosen, s.tasks)

    def one(k: int) -> tuple[int, Fold]:
        scored = model.score(features.filter(F.col("fold") == k), models[k]).select(*KEEP, "relevance")
        return k, _finished(Fold(fitted, models[k], scored), k, store)

    return dict(model.run_all(numbers, one, s.threads))


def _full(
    records: DataFrame, queries: Sequence[Query], s: Settings, numbers: list[int], store: str | None
) -> dict[int, Fold]:
    """Vocabularies, topics and scaling are refitted on the training rows of each fold.

    The folds are independent and submitted side by side.
    """

    def one(k: int) -> tuple[int, Fold]:
        training = F.col("fold") != k
        fitted, scaled = fitted_features(
            "full", records, training, queries, KEEP, n_topics=s.n_topics, lda_iterations=s.lda_iterations,
            no_below=s.no_below, keep_n=s.keep_n, passes=s.passes, topic_concentration=s.topic_concentration,
        )
        features = durable(scaled, "scaled")
        c = _chosen_c(features, [k], s)[k]
        best = model.fit_l1_logistic(features.filter(F.col("fold") != k).select("features", "label"), c, s.tasks)
        scored = model.score(features.filter(F.col("fold") == k), best).select(*KEEP, "relevance")
        topics = next(f for f in fitted.families if isinstance(f, Topics))
        # A few words for each topic.
        terms = durable(topics.terms(records.sparkSession, TOP_WORDS), "topic-terms")
        coherence = topic_coherence(records.filter(training), terms) if s.coherence else None
        return k, _finished(Fold(fitted, best, scored, terms, coherence), k, store)

    return dict(model.run_all(numbers, one, s.threads))


def _together(spark: SparkSession, fitted: dict[int, Fold]) -> CrossValidation:
    numbers = sorted(fitted)
    models = {k: fitted[k].model for k in numbers}

    def by_fold(tables: list[DataFrame | None]) -> DataFrame | None:
        parts = [t.withColumn("fold", F.lit(k)) for k, t in zip(numbers, tables) if t is not None]
        return reduce(DataFrame.unionByName, parts) if parts else None

    return CrossValidation(
        model.out_of_fold_scores([fitted[k].scores for k in numbers]),
        model.coefficients(spark, models, {k: fitted[k].features.names for k in numbers}),
        {k: m.c for k, m in models.items()},
        models,
        {k: fitted[k].features for k in numbers},
        by_fold([fitted[k].topics for k in numbers]),
        by_fold([fitted[k].coherence for k in numbers]),
    )


def report(result: CrossValidation, settings: Settings = Settings()) -> DataFrame:
    """The eleven-column report, one row per fold."""
    scores = result.scores
    spark = scores.sparkSession
    chosen = spark.createDataFrame(sorted(result.param_c.items()), "fold int, param_C double")
    models = chosen.join(model.support(result.coefficients), "fold")
    levels = curves.score_levels(scores)
    matrix = metrics.confusion(metrics.classify(scores, settings.cutoff))
    return metrics.fold_report(folds.fold_sizes(scores), models, matrix, curves.pr_auc(levels))


def curve_points(scores: DataFrame) -> DataFrame:
    """``plot, fold, x, y``: precision-recall envelopes and gain steps, per fold and overall."""
    parts = []
    for by, name in ((("fold",), F.concat(F.lit("fold"), F.col("fold") + 1)), ((), F.lit("overall"))):
        levels = curves.score_levels(scores, by)
        envelope = curves.pr_envelope(curves.pr_curve(levels, by), by)
        steps = curves.step_points(curves.gain_curve(levels, by), by)
        parts.append(
            envelope.select(
                F.lit("plot1").alias("plot"), name.alias("fold"), F.col("recall").alias("x"), F.col("precision").alias("y")
            )
        )
        parts.append(steps.select(F.lit("plot2").alias("plot"), name.alias("fold"), "x", "y"))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together


def save_performance(result: CrossValidation, path: str, settings: Settings = Settings()) -> None:
    """Everything an evaluation reports, under ``path``: report, curves, scores, coefficients
    and the greatest of them, confusion counts, micro average, score histograms, and for
    topic models their terms and coherence."""
    table = metrics.report_table(report(result, settings))
    matrix = metrics.confusion(metrics.classify(result.scores, settings.cutoff))
    # Tables of a few rows for each fold.
    small = {
        "evaluation_report": table,
        "coefficients": model.selected_features(result.coefficients),
        "feature_importance": model.feature_importance(result.coefficients),
        "confusion": matrix,
        "micro_average": metrics.micro_average(matrix),
        "score_histogram": metrics.score_histogram(result.scores),
        "topics": result.topic_terms,
        "coherence": result.coherence,
    }
    for name, rows in small.items():
        if rows is not None:
            rows.coalesce(1).write.csv(f"{path}/{name}", header=True)
    write_curves(curve_points(result.scores), f"{path}/curves")
    result.scores.write.parquet(f"{path}/scores")
