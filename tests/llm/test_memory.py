"""What a Python worker holds does not grow with what it has seen."""

import tracemalloc

import numpy as np
import pyarrow as pa

from citesift.llm import common, minhash_dedup, toxicity


def test_remembered_words_stay_small():
    minhash_dedup._WORDS.clear()
    tracemalloc.start()
    try:
        for k in range(40):
            text = " ".join(f"word{i}" for i in range(k * 10_000, (k + 1) * 10_000))
            assert len(minhash_dedup.shingles(text)) == 9_996
        del text
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
        minhash_dedup._WORDS.clear()
    assert held < 30e6


def test_pieces_cover_every_row():
    batches = [pa.record_batch({"x": list(range(a, b))}) for a, b in ((0, 0), (0, 1), (1, 1300), (1300, 1812))]
    found = list(common.pieces(iter(batches)))
    assert [x for p in found for x in p.column(0).to_pylist()] == list(range(1812))
    assert max(map(len, found)) <= common.PIECE


def test_a_worker_trains_alike_however_the_bags_are_cut(spark, monkeypatch):
    texts = [(i, ("vile scum " if i % 3 == 0 else "kind words ") + f"and word{i}") for i in range(1, 61)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id long, toxic int")
    towards, bias = toxicity.train(docs.repartition(7), labels)
    bags = [toxicity.bag(t) for _, t in texts]
    expected, expected_bias = toxicity.fit(bags, np.array([int(i % 3 == 0) for i, _ in texts]))
    assert np.array_equal(towards, expected) and bias == expected_bias
