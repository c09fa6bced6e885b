"""Fitted stages: agreement with an independent solver, and invariants."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from citesift.operators import features as feat
from citesift.operators import model
from citesift.operators.articles import temporal_split
from citesift.operators.feature_sets import feature_set, fitted_features
from citesift.operators.topics import Topics, topic_coherence, window_counts
from citesift.operators.variational import TopicModel
from citesift.plans import evaluate, update
from citesift.registry import views
from citesift.registry.modelling import MODEL_QUERIES
from citesift.sources.models import load_model, save_model

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = (rng.random((300, 8)) < 0.3).astype(float)
    x[:, 6], x[:, 7] = 1.0, 0.0
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=300) * 0.8 > 1.2).astype(int)
    df = spark.createDataFrame(
        [(i, i % 5, int(v), r.tolist()) for i, (r, v) in enumerate(zip(x, y))],
        "article_id long, fold int, label int, features array<double>",
    )
    return df.persist(), x, y


def reference_fit(x, y, c, steps=30000):
    """Accelerated proximal gradient on the same objective, intercept penalised."""
    a = np.c_[x, np.ones(len(y))]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    s = 2 * y - 1
    lip = c * 0.25 * np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2
    b = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        nb = z + c * a.T @ (w * s / (1 + np.exp(s * (a @ z)))) / lip
        nb = np.sign(nb) * np.maximum(np.abs(nb) - 1 / lip, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, b, t = nb + (t - 1) / nt * (nb - b), nb, nt
    objective = np.abs(b).sum() + c * (w * np.logaddexp(0, -s * (a @ b))).sum()
    return b, objective, (a, w, s)


@pytest.mark.parametrize("c", [0.03, 0.5])
def test_l1_fit_reaches_the_optimum(rows, c):
    df, x, y = rows
    fitted = model.fit_l1_logistic(df, c)
    b = np.r_[fitted.coefficients, fitted.intercept]
    _, best, (a, w, s) = reference_fit(x, y, c)
    value = np.abs(b).sum() + c * (w * np.logaddexp(0, -s * (a @ b))).sum()
    assert value == pytest.approx(best, rel=1e-6)


def test_collapsed_rows_give_the_same_model(rows):
    df, x, _ = rows
    collapsed = model.collapse(df)
    assert collapsed.count() < df.count()
    one, two = model.fit_l1_logistic(df, 0.3), model.fit_l1_logistic(collapsed, 0.3)
    scored = model.score(model.score(df, one).withColumnRenamed("relevance", "r1"), two)
    assert scored.agg(F.max(F.abs(F.col("r1") - F.col("relevance")))).first()[0] < 1e-5


def test_grid_search_takes_the_smallest_of_equals(rows):
    df, _, _ = rows
    search = model.grid_search_recall(df, [0, 1], [1e-6, 2e-6, 0.5])
    assert search.count() == 6
    recall = {(r["fold"], r["c"]): r["recall"] for r in search.collect()}
    best = {r["fold"]: r["c"] for r in model.best_c(search).collect()}
    for fold in (0, 1):
        # An all-zero model predicts no one at 0.5.
        assert recall[fold, 1e-6] == recall[fold, 2e-6] == 0.0
        assert best[fold] == 0.5 and recall[fold, 0.5] > 0
    only_zero = model.best_c(search.filter("c < 0.1"))
    assert {r["c"] for r in only_zero.collect()} == {1e-6}


def test_even_grid():
    grid = model.even_grid()
    assert len(grid) == 200 and grid[0] == 0.01 and grid[-1] == pytest.approx(1.0)


def test_importance_and_support(spark):
    table = spark.createDataFrame(
        [(0, "a", 0.5), (0, "b", -2.0), (0, "c", 1e-6), (0, "d", 0.5), (1, "a", 0.0)],
        "fold int, feature string, coefficient double",
    )
    assert {r["fold"]: r["support"] for r in model.support(table).collect()} == {0: 3, 1: 0}
    top = model.feature_importance(table, 2).filter("fold = 0").orderBy("rank").collect()
    assert [r["feature"] for r in top] == ["a", "d"]


def test_standardize_constant_column_is_centred_only(spark):
    train = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    test = spark.createDataFrame([([5.0, 7.0],)], "features array<double>")
    a, b = feat.standardize(train, test)
    assert sorted(r[0] for r in a.select("features").collect()) == [[-1.0, 0.0], [1.0, 0.0]]
    assert b.first()[0] == [3.0, 2.0]


def test_tfidf_of_document_without_vocabulary(spark):
    df = spark.createDataFrame([(1, ["ab", "cd", "ab", "cd"]), (2, ["zz"]), (3, [])], "article_id long, tokens array<string>")
    family = feat.BigramTfidf(["ab cd", "cd ab"], [1, 1], 3)
    got = {r["article_id"]: r["tfidf"] for r in family.transform(df).collect()}
    assert got[2] == got[3] == [0.0, 0.0]
    assert got[1] == pytest.approx(np.array([1 + np.log(2), 1]) / np.hypot(1 + np.log(2), 1))


def test_dictionary_is_capped_by_document_frequency(spark):
    docs = [(i, ["all", "all"] + (["some"] if i < 4 else []) + (["few"] if i < 2 else [])) for i in range(10)]
    df = spark.createDataFrame(docs, "article_id long, tokens array<string>")
    kept = feat.lda_dictionary(df, 10, no_below=2, no_above=0.4, keep_n=1).collect()
    assert [(r["term"], r["df"]) for r in kept] == [("some", 4)]


def test_topics(spark):
    records = views.records(spark, SF_DIR)
    topics = Topics.fit(records, 5, max_iter=5)
    weights = topics.transform(records).select("topic_weights").collect()
    assert len(weights) == 200
    assert all(sum(r[0]) == pytest.approx(1.0) and len(r[0]) == 5 for r in weights)
    unknown = spark.createDataFrame([(1, ["qqq"])], "article_id long, tokens array<string>")
    assert topics.transform(unknown).first()["topic_weights"] == [0.2] * 5
    terms = topics.terms(spark, 4)
    assert terms.count() == 20 and set(r["term"] for r in terms.collect()) <= set(topics.vocab)
    coherence = topic_coherence(records, terms)
    assert coherence.count() == 5


def test_window_counts_by_listing_windows(spark):
    rng = np.random.default_rng(1)
    docs = [(i, [str(t) for t in rng.choice(list("abcdefgh"), n)]) for i, n in enumerate([1, 3, 9, 10, 11, 25, 60, 2])]
    docs.append((99, ["h"] * 5))
    df = spark.createDataFrame(docs, "article_id long, tokens array<string>")
    given = spark.createDataFrame([(0, w) for w in "abc"] + [(1, w) for w in "cd"], "topic int, term string")
    pairs, total = window_counts(df, given, 10)
    words, windows = {0: "abc", 1: "cd"}, []
    for _, tokens in docs:
        if set(tokens) & set("abcd"):
            windows += [set(tokens[s : s + 10]) for s in range(max(1, len(tokens) - 9))]
    assert total.first()["n_windows"] == len(windows)
    got = {(r["topic"], r["term_a"], r["term_b"]): r["windows"] for r in pairs.collect()}
    for topic, terms in words.items():
        for i, a in enumerate(terms):
            for b in terms[i:]:
                assert got.get((topic, a, b), 0) == sum(a in w and b in w for w in windows)


@pytest.fixture(scope="module")
def simple(spark):
    return evaluate.cross_validate(views.articles(spark, SF_DIR), MODEL_QUERIES, evaluate.Settings(c=0.5))


def test_each_document_is_scored_once(simple, spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    assert simple.scores.count() == labels.count() == simple.scores.select("article_id").distinct().count()
    assert simple.scores.filter("relevance between 0 and 1").count() == labels.count()


def test_refit_gives_the_same_scores(simple, spark):
    again = evaluate.cross_validate(views.articles(spark, SF_DIR), MODEL_QUERIES, evaluate.Settings(c=0.5))
    gap = simple.scores.alias("a").join(again.scores.alias("b"), "article_id")
    assert gap.agg(F.max(F.abs(F.col("a.relevance") - F.col("b.relevance")))).first()[0] < 1e-6


def test_report_and_files(simple, spark, tmp_path):
    report = evaluate.report(simple)
    assert report.columns[0] == "fold" and report.count() == 5
    evaluate.save_performance(simple, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/evaluation_report"), header=True).count() == 6
    curves = spark.read.option("header", True).csv(str(tmp_path / "out/curves"))
    assert curves.select("plot", "fold").distinct().count() == 12
    rows = lambda name: spark.read.csv(str(tmp_path / "out" / name), header=True)
    assert rows("confusion").count() == 5 and rows("micro_average").count() == 1
    assert rows("score_histogram").count() == 150
    assert rows("feature_importance").groupBy("fold").count().filter("count = 10").count() == 5
    assert rows("coefficients").count() == model.selected_features(simple.coefficients).count()


def test_full_feature_set_is_scaled_by_training_rows(spark):
    records = views.labelled_records(spark, SF_DIR)
    train = records.filter("fold <> 0")
    fitted = feature_set("full", train, MODEL_QUERIES, n_topics=4, lda_iterations=2, no_below=5)
    rows = np.array([r[0] for r in fitted.transform(train, []).select("features").collect()])
    assert rows.shape[1] == len(fitted.names) == len(set(fitted.names))
    assert np.abs(rows.mean(axis=0)).max() < 1e-9
    assert all(s == pytest.approx(1.0) or s < 1e-9 for s in rows.std(axis=0))


def test_new_documents_are_ranked(spark, simple, tmp_path):
    articles = views.articles(spark, SF_DIR)
    old, new = temporal_split(articles)
    scored = update.score_new(old, new, MODEL_QUERIES, c=0.5)
    assert scored.count() == new.count()
    update.save_tables(scored, new, simple.scores, articles, str(tmp_path / "tables"))
    table = spark.read.json(str(tmp_path / "tables/new_articles"))
    assert [r["rank"] for r in table.orderBy("rank").collect()] == list(range(1, new.count() + 1))


@pytest.mark.parametrize("kind", ["simple", "full"])
def test_saved_model_scores_alike(spark, tmp_path, kind):
    records = views.labelled_records(spark, SF_DIR)
    fitted = feature_set(kind, records, MODEL_QUERIES, n_topics=3, lda_iterations=2, no_below=5)
    rows = fitted.transform(records, ["article_id", "label"])
    best = model.fit_l1_logistic(rows, 0.5)
    save_model(spark, fitted, best, str(tmp_path / "m"))
    features, again = load_model(spark, str(tmp_path / "m"))
    one = model.score(rows, best).select("article_id", F.col("relevance").alias("r1"))
    two = model.score(features.transform(records, ["article_id"]), again).join(one, "article_id")
    assert two.agg(F.max(F.abs(F.col("relevance") - F.col("r1")))).first()[0] < 1e-9
    assert features.names == fitted.names


@pytest.mark.parametrize("kind, k", [("simple", 5), ("full", 3)])
def test_a_stopped_evaluation_goes_on_where_it_was(spark, tmp_path, monkeypatch, kind, k):
    """All but the last folds finish, the run stops, the next one fits the others and yields the same."""
    chosen = evaluate.Settings(kind, k, c=0.5, n_topics=3, lda_iterations=2, passes=2.0, no_below=5, threads=1)
    articles, store = views.articles(spark, SF_DIR), str(tmp_path / "store")
    finish, fits = evaluate._finished, []

    def stopping(*args):
        if len(fits) == stop:
            raise RuntimeError("stopped")
        fits.append(args)
        return finish(*args)

    monkeypatch.setattr(evaluate, "_finished", stopping)
    stop = k - 3 or 1
    with pytest.raises(RuntimeError, match="stopped"):
        evaluate.cross_validate(articles, MODEL_QUERIES, chosen, store)
    stop = -1
    fits.clear()
    resumed = evaluate.cross_validate(articles, MODEL_QUERIES, chosen, store)
    assert len(fits) == k - (k - 3 or 1)
    fits.clear()
    again = evaluate.cross_validate(articles, MODEL_QUERIES, chosen, store)
    assert not fits and again.param_c == resumed.param_c
    assert sorted(map(tuple, again.scores.collect())) == sorted(map(tuple, resumed.scores.collect()))
    assert sorted(map(tuple, again.coefficients.collect())) == sorted(map(tuple, resumed.coefficients.collect()))
    if kind == "full":
        assert again.topic_terms.groupBy("fold").agg(F.count_distinct("topic").alias("n")).filter("n = 3").count() == k
        assert again.coherence.count() == 3 * k
    else:
        whole = evaluate.cross_validate(articles, MODEL_QUERIES, chosen)
        gap = whole.scores.alias("a").join(again.scores.alias("b"), "article_id")
        assert gap.count() == whole.scores.count()
        assert gap.agg(F.max(F.abs(F.col("a.relevance") - F.col("b.relevance")))).first()[0] < 1e-6
    with pytest.raises(ValueError, match="other settings"):
        evaluate.cross_validate(articles, MODEL_QUERIES, replace(chosen, c=0.1), store)


@pytest.mark.parametrize("kind", ["simple", "full"])
def test_features_of_all_rows_are_worked_out_once(spark, monkeypatch, kind):
    """The same features as by fitting on the training rows and transforming all rows, with every topic inferred once."""
    rows = [
        (i, None if i == 7 else i % 3, f"word{i % 4} common{i % 2} term{i % 5} rare risk{i % 3}".split() * 3, "Clinical Trial" if i % 2 else None)
        for i in range(60)
    ]
    records = spark.createDataFrame(rows, "article_id long, fold int, tokens array<string>, publication_types string").persist()
    arguments = {"n_topics": 3, "lda_iterations": 2, "no_below": 2}
    fitted = feature_set(kind, records.filter("fold <> 0"), MODEL_QUERIES, **arguments)
    expected = {r[0]: r[1] for r in fitted.transform(records, ["article_id"]).collect()}
    # Sums of a fit are added in any order, so a second one is equal only up to its tolerance.
    for topics in [f for f in fitted.families if isinstance(f, Topics)]:
        monkeypatch.setattr(Topics, "fit", lambda *a, topics=topics, **k: topics)
    shares, asked = TopicModel.shares, []
    monkeypatch.setattr(TopicModel, "shares", lambda *a: asked.append(a) or shares(*a))
    once, found = fitted_features(kind, records, F.col("fold") != 0, MODEL_QUERIES, ["article_id"], **arguments)
    assert found.columns == ["article_id", "features"] and once.names == fitted.names
    got = {r[0]: r[1] for r in found.collect()}
    assert got.keys() == expected.keys() and len(asked) == (kind == "full")
    assert max(abs(a - b) for i in got for a, b in zip(got[i], expected[i], strict=True)) < 1e-9
    records.unpersist()
