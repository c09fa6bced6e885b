"""Folds, the model, its tuning and inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.functions.text import tokenize
from citesift.operators import folds, model
from citesift.operators.feature_sets import feature_set
from citesift.operators.features import SearchTerms
from citesift.operators.retrieval import Query
from citesift.plans import evaluate
from citesift.registry import views
from citesift.session import durable

# Search terms of the model queries, chosen to be frequent in the test texts.
MODEL_QUERIES = views.QUERIES + (Query("thatin AND (ononst OR inoran)", (("thatin",), ("ononst", "inoran", "rewh"))),)
GRID = model.even_grid()
SETTINGS = evaluate.Settings(grid=GRID, parts=views.PARTS, tasks=views.PARTS)
# Fits at one strength. The default one selects nothing from a few hundred labelled documents.
FIXED_C = evaluate.Settings(c=1.0, parts=views.PARTS, tasks=views.PARTS)
# The published sizes: 50 topics, 200 values of C.
FULL = evaluate.Settings("full", grid=GRID, lda_iterations=10, coherence=False, parts=views.PARTS, tasks=views.PARTS)
# Residual of an optimality condition, as a share of the penalty, up to which it holds.
CERTIFIED = 1e-5


def _labels(spark, sf_dir) -> DataFrame:
    labels = views.table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("article_id"), F.col("toxic").alias("label"))


def stratified_folds(spark, sf_dir) -> DataFrame:
    return folds.stratified_folds(_labels(spark, sf_dir))


def kfold(spark, sf_dir) -> DataFrame:
    return folds.kfold(_labels(spark, sf_dir))


def fold_sizes(spark, sf_dir) -> DataFrame:
    return folds.fold_sizes(stratified_folds(spark, sf_dir))


def class_weights(spark, sf_dir) -> DataFrame:
    return folds.class_weights(_labels(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def score(spark, sf_dir) -> DataFrame:
    """The fixed weights as a model over search-term features of the text."""
    words = list(views.SCORE_WEIGHTS)
    fixed = model.L1Model(list(views.SCORE_WEIGHTS.values()), views.SCORE_INTERCEPT, model.DEFAULT_C)
    docs = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"), tokenize(F.col("text")).alias("tokens")
    )
    flagged = SearchTerms(words, words, "features").transform(docs)
    return model.score(flagged, fixed).select("article_id", F.round("relevance", 6).alias("relevance"))


def _class_differences(spark, sf_dir) -> DataFrame:
    """``fold, feature, coefficient``: for every score word, how much more often it is
    in relevant documents outside the fold. Plays the coefficients of fitted models."""
    words = list(views.SCORE_WEIGHTS)
    docs = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"), tokenize(F.col("text")).alias("t")
    )
    # Sums per fold first: 5 rows, from which the rest of each fold follows.
    counted = docs.join(stratified_folds(spark, sf_dir), "article_id").withColumn(
        "w", F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.array_contains("t", w).alias("hit")) for w in words]))
    )
    sums = counted.groupBy("fold", F.col("w.word").alias("feature")).agg(
        *[F.count_if(F.col("label") == y).alias(f"n{y}") for y in (0, 1)],
        *[F.count_if((F.col("label") == y) & F.col("w.hit")).alias(f"h{y}") for y in (0, 1)],
    )
    total = sums.groupBy("feature").agg(*[F.sum(c).alias(f"a{c}") for c in ("n0", "n1", "h0", "h1")])
    share = lambda y: (F.col(f"ah{y}") - F.col(f"h{y}")) / (F.col(f"an{y}") - F.col(f"n{y}"))
    return sums.join(total, "feature").select("fold", "feature", F.round(share(1) - share(0), 6).alias("coefficient"))


def selected_features(spark, sf_dir) -> DataFrame:
    return model.selected_features(_class_differences(spark, sf_dir))


def support(spark, sf_dir) -> DataFrame:
    return model.support(_class_differences(spark, sf_dir))


def feature_importance(spark, sf_dir) -> DataFrame:
    return model.feature_importance(_class_differences(spark, sf_dir), 3)


def out_of_fold_scores(spark, sf_dir) -> DataFrame:
    scores = views.scores(spark, sf_dir)
    return model.out_of_fold_scores([scores.filter(F.col("fold") == f) for f in range(5)])


def fit_l1_logistic(spark, sf_dir) -> DataFrame:
    """For every fold and feature of the simple set, whether the fit meets the optimality condition.

    The coefficients themselves are ``fold_coefficients``.
    """
    result, features = _simple_fits(spark, sf_dir)
    names = result.features[0].names
    found = model.optimality(features, result.models, names).filter("feature <> '(intercept)'")
    return found.select("fold", "feature", "documents", (F.col("residual") <= CERTIFIED).alias("optimal"))


def _simple_fits(spark, sf_dir) -> tuple[evaluate.CrossValidation, DataFrame]:
    articles = views.articles(spark, sf_dir)
    result = evaluate.cross_validate(articles, MODEL_QUERIES, FIXED_C)
    records = views.labelled_records(spark, sf_dir)
    return result, durable(result.features[0].transform(records, evaluate.KEEP), "features")


def fold_coefficients(spark, sf_dir) -> DataFrame:
    """Coefficients of the five fold models of the simple set."""
    return evaluate.cross_validate(views.articles(spark, sf_dir), MODEL_QUERIES, FIXED_C).coefficients


def cross_validated_scores(spark, sf_dir) -> DataFrame:
    return evaluate.cross_validate(views.articles(spark, sf_dir), MODEL_QUERIES, FIXED_C).scores


def scored_once(spark, sf_dir) -> DataFrame:
    """Every labelled document with its fold, and whether it has one score that is a probability."""
    scores = cross_validated_scores(spark, sf_dir)
    return scores.groupBy("article_id", "fold", "label").agg(
        (F.count_if((F.col("relevance") >= 0) & (F.col("relevance") <= 1)) == 1).alias("scored")
    )


def _search(spark, sf_dir) -> DataFrame:
    records = durable(views.labelled_records(spark, sf_dir), "records")
    features = durable(feature_set("simple", records, MODEL_QUERIES).transform(records, evaluate.KEEP), "features")
    return model.grid_search_recall(features, range(5), GRID, tasks=views.PARTS)


def grid_search_recall(spark, sf_dir) -> DataFrame:
    """For every fold, what was searched and whether the chosen value of C is the one to choose.

    The values and recalls themselves are ``searched_c``.
    """
    search = _search(spark, sf_dir)
    tried = search.groupBy("fold").agg(
        F.count_distinct("c").alias("n_values"),
        F.round(F.min("c"), 6).alias("least"),
        F.round(F.max("c"), 6).alias("greatest"),
        F.count_if((F.col("recall") >= 0) & (F.col("recall") <= 1)).alias("n_recalls"),
        F.max("recall").alias("_best"),
    )
    chosen = model.best_c(search)
    better = search.join(chosen.selectExpr("fold", "c as _c", "recall as _recall"), "fold").groupBy("fold").agg(
        F.count_if((F.col("recall") > F.col("_recall") + 1e-9) | ((F.col("c") < F.col("_c")) & (F.col("recall") > F.col("_recall") - 1e-13))).alias("n_better")
    )
    return tried.join(better, "fold").drop("_best")


def searched_c(spark, sf_dir) -> DataFrame:
    """The value of C of every fold by the full search, with its recall."""
    return model.best_c(_search(spark, sf_dir))


def evaluate_simple(spark, sf_dir) -> DataFrame:
    """The flagship: how much screening does the simple model save?"""
    return evaluate.report(evaluate.cross_validate(views.articles(spark, sf_dir), MODEL_QUERIES, SETTINGS), SETTINGS)


def evaluate_full(spark, sf_dir) -> DataFrame:
    """All four feature families, topics refitted in every fold, the full search of C in each."""
    result = evaluate.cross_validate(views.articles(spark, sf_dir), MODEL_QUERIES, FULL)
    return evaluate.report(result, FULL)


QUERIES = {
    "stratified_folds": stratified_folds,
    "kfold": kfold,
    "fold_sizes": fold_sizes,
    "class_weights": class_weights,
    "score": score,
    "selected_features": selected_features,
    "support": support,
    "feature_importance": feature_importance,
    "out_of_fold_scores": out_of_fold_scores,
    "fit_l1_logistic": fit_l1_logistic,
    "fold_coefficients": fold_coefficients,
    "cross_validated_scores": cross_validated_scores,
    "scored_once": scored_once,
    "grid_search_recall": grid_search_recall,
    "searched_c": searched_c,
    "evaluate_simple": evaluate_simple,
    "evaluate_full": evaluate_full,
}

_WORDS = ", ".join(f"'{w}'" for w in views.SCORE_WEIGHTS)
_DIFFERENCES = f"""with {views.SQL_FOLDS},
docs as (select doc_id as article_id, {views.sql_tokens('text')} as t from documents),
hits as (select fold, label, word as feature, list_contains(t, word) as hit
         from docs join folds using (article_id), (select unnest([{_WORDS}]) as word)),
differences as (
  select f.fold, h.feature,
    round(avg(cast(hit as int)) filter (h.label = 1) - avg(cast(hit as int)) filter (h.label = 0), 6) as coefficient
  from (select distinct fold from folds) f join hits h on h.fold <> f.fold group by 1, 2)"""

ORACLE = {
    "stratified_folds": f"with {views.SQL_FOLDS} select * from folds",
    "kfold": """select doc_id as article_id, toxic as label,
  cast((row_number() over (order by md5(concat('142:', doc_id)), doc_id) - 1) % 3 as int) as fold from labels""",
    "fold_sizes": f"""with {views.SQL_FOLDS},
t as (select count(*) filter (label = 0) as t0, count(*) filter (label = 1) as t1 from folds),
e as (select fold, count(*) filter (label = 0) as e0, count(*) filter (label = 1) as e1 from folds group by fold)
select fold, t0 - e0 as train_0, t1 - e1 as train_1, e0 as test_0, e1 as test_1 from e, t""",
    "class_weights": """select toxic as label, count(*) as n,
  round((select count(*) from labels) / (2 * count(*)), 6) as weight from labels group by toxic""",
    "score": f"with {views.sql_scored()} select * from scored",
    "selected_features": f"{_DIFFERENCES} select * from differences where abs(coefficient) >= 1e-5",
    "support": f"{_DIFFERENCES} select fold, count(*) filter (abs(coefficient) >= 1e-5) as support from differences group by fold",
    "feature_importance": f"""{_DIFFERENCES} select * from (
  select *, cast(row_number() over (partition by fold order by coefficient desc, feature) as int) as rank
  from differences) where rank <= 3""",
    "out_of_fold_scores": f"with {views.sql_scores()} select * from scores",
    # The training documents that have each of the search terms.
    "fit_l1_logistic": f"""with {views.SQL_RECORDS}, {views.SQL_FOLDS},
words as (select unnest(list_distinct({views.sql_lemmas("q")})) as w
          from (select '{" ".join(q.text() for q in MODEL_QUERIES)}' as q)),
vocab as (select w as term, w || '_in_abstract' as feature from words
          union all select 'title_' || w, w || '_in_title' from words),
held as (select f.fold, r.tokens from records r join folds f using (article_id))
select o.fold, feature, (select count(*) from held where held.fold <> o.fold and list_contains(tokens, term)) as documents,
  true as optimal
from (select distinct fold from folds) o, vocab""",
    "scored_once": f"with {views.SQL_FOLDS} select article_id, fold, label, true as scored from folds",
    "grid_search_recall": f"""with {views.SQL_FOLDS}
select distinct fold, cast(200 as bigint) as n_values, 0.01::double as least, 1.0::double as greatest,
  cast(200 as bigint) as n_recalls, cast(0 as bigint) as n_better from folds""",
}
