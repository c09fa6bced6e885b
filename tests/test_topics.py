"""Inference of topics: against plain steps, and against Spark's own estimator."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from citesift.operators import variational
from citesift.operators.topics import Topics
from citesift.sources.models import load_model

ALPHA = 0.2


def _texts(n: int, seed: int) -> list[list[str]]:
    """Each text mixes two of six groups of words."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        groups = rng.choice(6, 2, replace=False)
        texts.append([f"w{g}_{int(rng.exponential(8))}" for g in rng.choice(groups, int(rng.integers(1, 120)))])
    return texts


def _records(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "article_id long, tokens array<string>").repartition(4, "article_id")


def _bound(bags, weights, mass) -> np.ndarray:
    """What the inference of a document maximises, but for a constant."""
    total = mass.sum(axis=1)
    shares = variational.exp_digamma(mass) / variational.exp_digamma(total)[:, None]
    lgamma = np.vectorize(math.lgamma)
    found = ((ALPHA - mass) * np.log(shares)).sum(axis=1) + lgamma(mass).sum(axis=1) - lgamma(total)
    for i, share in enumerate(shares):
        place = slice(bags.ends[i], bags.ends[i + 1])
        found[i] += bags.counts[place] @ np.log(weights[bags.terms[place]] @ share)
    return found


def test_exp_digamma():
    # digamma at 1/2, 1, 10 and near 0.
    known = {0.5: -1.9635100260214235, 1.0: -0.5772156649015329, 10.0: 2.2517525890667211, 0.01: -100.56088545786867}
    assert np.log(variational.exp_digamma(np.array(list(known)))) == pytest.approx(list(known.values()), abs=1e-8)


def test_counted_terms():
    tokens = pa.array([["b", "a", "b", None], [], None, ["zz"], ["c"]]).slice(0, 5)
    for texts, ends in ((tokens, [0, 2, 2, 2, 2, 3]), (tokens.slice(1), [0, 0, 0, 0, 1])):
        bags = variational.Bags.of(texts, pa.array(["a", "b", "c"]))
        assert bags.ends.tolist() == ends
    whole = variational.Bags.of(tokens, pa.array(["a", "b", "c"]))
    assert (whole.terms.tolist(), whole.counts.tolist()) == ([0, 1, 2], [1, 2, 1])


def test_inference_needs_few_steps_while_topics_are_alike(monkeypatch):
    """As good a result as of plain steps, in less than a third of them, and each document rests."""
    texts = _texts(150, 1) + [[], ["unknown"]]
    vocab = sorted({t for text in texts for t in text} - {"unknown"})
    bags = variational.Bags.of(pa.array(texts), pa.array(vocab))
    rng = np.random.default_rng(2)
    weights = variational._expected(rng.gamma(100, 0.01, (len(vocab), 20)))
    start, every = rng.gamma(100, 0.01, (len(bags), 20)), np.arange(len(bags))
    plain_steps = 0
    plain = start.copy()
    for i in range(150):
        place = slice(bags.ends[i], bags.ends[i + 1])
        x, n, gap = weights[bags.terms[place]], bags.counts[place], np.inf
        while gap > variational.TOLERANCE:
            share = variational.exp_digamma(plain[i])
            new = ALPHA + share * ((n / (x @ share)) @ x)
            gap, plain[i] = np.abs(new - plain[i]).mean(), new
            plain_steps += 1
    steps = 0
    original = variational.exp_digamma

    def counted(x):
        nonlocal steps
        steps += len(x)
        return original(x)

    monkeypatch.setattr(variational, "exp_digamma", counted)
    mass = variational.infer(bags, every, start, weights, ALPHA)
    monkeypatch.undo()
    assert 3 * steps < plain_steps
    assert (mass[150:] == ALPHA).all() and mass.sum(axis=1) == pytest.approx(
        [20 * ALPHA + bags.counts[a:b].sum() for a, b in zip(bags.ends, bags.ends[1:])]
    )
    known = variational.Bags(bags.ends[:151], bags.terms, bags.counts)
    gain = _bound(known, weights, mass[:150]) - _bound(known, weights, plain[:150])
    assert abs(gain.mean()) < 0.2
    # A few documents alone, in another order, come out the same.
    some = np.array([70, 3, 149])
    assert variational.infer(bags, some, start[some], weights, ALPHA) == pytest.approx(mass[some], abs=1e-6)


def test_fit_agrees_with_the_estimator_of_spark(spark):
    texts = _texts(600, 3) + [[], None]
    records = _records(spark, texts)
    n, k = len(texts), 6
    fitted = Topics.fit(records, k, alpha=k * ALPHA, max_iter=10, no_below=5, no_above=0.9)
    counter = CountVectorizerModel.from_vocabulary(fitted.vocab, inputCol="tokens", outputCol="bow")
    counted = counter.transform(records.filter("tokens is not null")).cache()
    spark_fit = LDA(
        k=k, optimizer="online", docConcentration=[ALPHA], optimizeDocConcentration=False, subsamplingRate=1.0,
        maxIter=10, seed=42, featuresCol="bow", topicDistributionCol="topics",
    ).fit(counted)
    theirs = spark_fit.topicsMatrix().toArray()
    ours = fitted.model.weights
    # Both draw with replacement.
    assert ours.sum() == pytest.approx(theirs.sum(), rel=0.05)
    bags = variational.Bags.of(pa.array(texts), pa.array(fitted.vocab))
    start = np.random.default_rng(5).gamma(100, 0.01, (n, k))
    bounds = []
    for weights in (variational._expected(ours), variational._expected(theirs)):
        bounds.append(_bound(bags, weights, variational.infer(bags, np.arange(n), start, weights, ALPHA)).sum())
    assert bounds[0] == pytest.approx(bounds[1], rel=0.03)
    # The same topics give the same weights of documents, but for other random starts.
    same = variational.TopicModel(theirs, ALPHA, 42)
    mine = records.select("article_id", same.shares(spark, F.col("tokens"), fitted.vocab).alias("mine"))
    both = spark_fit.transform(counted).select("article_id", vector_to_array("topics").alias("theirs")).join(mine, "article_id")
    gaps = [max(abs(a - b) for a, b in zip(r["mine"], r["theirs"])) for r in both.collect() if sum(r["theirs"])]
    assert len(gaps) > 550 and np.median(gaps) < 1e-3


def test_all_texts_have_weights_and_equal_ones_the_same(spark):
    texts = _texts(80, 4)
    records = _records(spark, texts + texts[:5] + [[], None, [None]])
    fitted = Topics.fit(records, 4, max_iter=3, no_below=2, no_above=0.9)
    again = Topics.fit(records, 4, max_iter=3, no_below=2, no_above=0.9)
    assert np.allclose(fitted.model.weights, again.model.weights)
    found = {r["article_id"]: r["topic_weights"] for r in fitted.transform(records).collect()}
    assert len(found) == 88 and all(sum(w) == pytest.approx(1) and min(w) > 0 for w in found.values())
    for i in range(5):
        assert found[i] == pytest.approx(found[80 + i], abs=1e-9)
    assert found[85] == found[86] == found[87] == pytest.approx([0.25] * 4)
    terms = fitted.terms(spark, len(fitted.vocab) + 1).collect()
    assert len(terms) == 4 * len(fitted.vocab)
    for topic in range(4):
        rows = sorted((r for r in terms if r["topic"] == topic), key=lambda r: r["rank"])
        weights = [r["weight"] for r in rows]
        assert sum(weights) == pytest.approx(1) and weights == sorted(weights, reverse=True)
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and {r["term"] for r in rows} == set(fitted.vocab)


def test_a_store_of_the_former_estimator_is_read(spark, tmp_path):
    vocab = ["a", "b", "c"]
    records = _records(spark, [["a", "b"], ["b", "c"], ["c", "a", "a"]] * 5)
    counted = CountVectorizerModel.from_vocabulary(vocab, inputCol="tokens", outputCol="features").transform(records)
    former = LDA(k=2, optimizer="online", docConcentration=[0.5], optimizeDocConcentration=False, maxIter=2, seed=9).fit(counted)
    former.write().overwrite().save(str(tmp_path / "topics"))
    parameters = {
        "families": [["topics", {"vocab": vocab, "n_topics": 2, "fitted": True}]],
        "scaler": None, "names": [], "model": {"coefficients": [], "intercept": 0.0, "c": 1.0},
    }
    spark.createDataFrame([(json.dumps(parameters),)], "value string").write.text(str(tmp_path / "parameters"))
    features, _ = load_model(spark, str(tmp_path))
    topics = features.families[0]
    assert np.allclose(topics.model.weights, former.topicsMatrix().toArray()) and topics.model.alpha == 0.5
    assert all(sum(r[0]) == pytest.approx(1) for r in topics.transform(records).select("topic_weights").collect())
