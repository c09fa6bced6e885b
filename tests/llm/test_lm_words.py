"""Words beyond the most frequent ones have log-bilinear probabilities of their own."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citesift.llm import lm_scoring as lm
from citesift.llm import lm_words


@pytest.mark.parametrize("frequent", [1 << 18, 200])
def test_a_rare_word_is_likelier_where_it_was_seen(spark, monkeypatch, frequent):
    """With the words broadcast, and with most of them in shards."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    named = ["first", "second", *(f"f{i}" for i in range(lm.CLASSES - 4))]
    texts = [" ".join([w] * 200) for w in named]
    texts += [f"{a} {b}{i}" for a, b in (("first", "x"), ("second", "y")) for i in range(150) for _ in range(10)]
    asked = ["first x5", "first y5", "second x5", "second y5", "first unseen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # 5 ids that are held out, so nothing is learnt from them.
    held = docs.sparkSession.range(10**6, 10**6 + 200).filter(lm.held_out(F.col("id"))).limit(len(asked)).collect()
    rows = spark.createDataFrame([(r.id, t) for r, t in zip(held, asked)], docs.schema)
    found = {r.doc_id: r for r in lm.score(docs.unionAll(rows)).collect() if r.held_out and r.doc_id >= 10**6}
    by_text = {t: found[r.id] for r, t in zip(held, asked)}
    gain = {t: r.score - r.base_score for t, r in by_text.items()}
    # Half of the words follow each of the two; before, the context made no difference among them.
    assert gain["first x5"] > gain["first y5"] + 0.3 and gain["second y5"] > gain["second x5"] + 0.3
    assert all(np.isfinite(r.score) for r in found.values()) and by_text["first unseen"].n_known == 2


def test_words_of_the_class_and_an_unseen_one_sum_to_one(spark):
    rng = np.random.default_rng(1)
    n, many = 90, 150
    deal = lm_words.Deal(n, many)
    hashes = rng.integers(-(2**62), 2**62, n + many)
    features = rng.normal(0, 0.5, (40, 6)).astype(np.float32)
    word = np.concatenate([np.arange(n + many), rng.integers(0, n + many, 4000)])
    ctx = rng.integers(0, 30, len(word))
    rank = np.where(word < n, word, -1)
    halves = [
        row for half in (slice(0, 2000), slice(2000, None))
        for row in lm_words.packed_counts(rank[half], hashes[word[half]], ctx[half], deal)
    ]
    counted = spark.createDataFrame(pd.DataFrame(halves, columns=lm_words.PACKED.names), "shard int, word binary, ctx binary, n binary")
    seen = float(np.log10(1 - 1 / 1000))
    words, beyond = lm_words.fit(counted, deal, features, seen)
    shards = {r["part"]: r for r in beyond.collect()}
    for c in (0, 7, 39):
        total = (10 ** words.logs(np.arange(n), np.full(n, c))).sum()
        for part, row in shards.items():
            mine = hashes[n:][hashes[n:] % deal.parts == part]
            counts, logs = words.logs_beyond(mine, np.full(len(mine), c), part, row)
            assert counts.tolist() == [(hashes[word] == h).sum() for h in mine]
            total += (10**logs).sum()
        assert total + 1 / 1000 == pytest.approx(1, abs=1e-4)
    assert words.logs_beyond(np.array([1 * deal.parts]), np.array([0]), 0, shards[0])[0].tolist() == [0]
