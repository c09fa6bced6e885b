"""The language model learns from every triple that was counted."""

import numpy as np

from citesift.llm import lm_scoring as lm


def _triple(a, b, w):
    return (a * (lm.CLASSES + 1) + b) * lm.CLASSES + w


def test_a_triple_counted_once_in_many_is_learnt_from():
    triples = np.array([_triple(2, 3, 4), _triple(3, 4, 2), _triple(50, 60, 70)])
    counts = np.array([10**9, 10**9, 1])
    noise = np.ones(lm.CLASSES) / lm.CLASSES
    before = lm.Model(noise)
    after = lm.train_shard(lm.Model(noise), triples, counts, noise, 1, 0.08)
    for seen in (2, 3, 4, 50, 60):
        assert not np.array_equal(before.context[seen], after.context[seen])
    # Of a class in no context there is nothing to learn.
    assert np.array_equal(before.context[90], after.context[90])


def test_frequent_continuations_become_likely():
    rng = np.random.default_rng(3)
    contexts = rng.integers(2, 20, (400, 2))
    contexts = np.unique(contexts, axis=0)
    triples = np.concatenate([_triple(contexts[:, 0], contexts[:, 1], 2 + contexts[:, 1]), _triple(contexts[:, 0], contexts[:, 1], 30)])
    counts = np.repeat([9, 1], len(contexts))
    noise = np.ones(lm.CLASSES)
    np.add.at(noise, triples % lm.CLASSES, counts)
    model = lm.train_shard(lm.Model(noise / noise.sum()), triples, counts, noise / noise.sum(), 1, 0.08)
    table = model.log_probabilities()
    rows = contexts[:, 0] * (lm.CLASSES + 1) + contexts[:, 1]
    assert (table[rows, 2 + contexts[:, 1]] > np.log10(0.6)).all()
