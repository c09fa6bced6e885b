"""Hard negatives against all products worked out one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citesift.llm import hard_negatives
from citesift.llm.hard_negatives import LIMIT, LONG, Mining

SCHEMA = "vec_id long, embedding array<double>, label int, key string, v string, rank string, dest string"


def _brute(rows, every, rule=Mining(), scale=256.0):
    def whole(x):
        return max(-LIMIT, min(LIMIT, math.floor(x * scale))) if math.isfinite(x * scale) else int(math.copysign(LIMIT, x))

    def cut(x):
        return max(-LONG - 1, min(LONG, x))

    usable = [
        (i, y, [whole(x) for x in v])
        for i, v, y in rows
        if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for own, label, a in usable:
        if own % every:
            continue
        scores = [(cut(sum(x * y for x, y in zip(a, v))), i, y) for i, y, v in usable if i != own and len(v) == len(a)]
        for p, positive in sorted((-s, i) for s, i, y in scores if y == label)[: rule.positives]:
            found = sorted((-s, i) for s, i, y in scores if y != label and rule.low * -p <= 100 * s <= rule.high * -p)
            out += [(own, positive, k + 1, i, -p, -s) for k, (s, i) in enumerate(found[: rule.negatives])]
    return sorted(out)


@pytest.fixture
def small_steps(monkeypatch):
    """Several chunks, anchor groups and tasks on small tables."""
    monkeypatch.setattr(hard_negatives, "CHUNK", 7)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "LEAST_IN_TASK", 11)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def _mined(spark, rows, every):
    return sorted(tuple(r) for r in hard_negatives.mine(_frame(spark, rows), F.col("vec_id") % every == 0).collect())


def test_ties_repeats_lengths_and_odd_rows(spark, small_steps):
    rng = np.random.default_rng(0)
    rows = [
        (int(i), [float(x) for x in rng.integers(-3, 4, rng.choice([3, 11]))], int(rng.integers(0, 3)))
        for i in rng.integers(0, 60, 200)
    ]
    rows += [(0, [], 1), (100, [], 1), (5, [1e300, 2.0, 3.0], 1), (10, [1e9, -2e12, 3.5], 2), (20, [1e9, -2e12, 3.5], 2)]
    rows += [(21, [3e8, -5e11, 3.5], 1), (None, [1.0, 2.0, 3.0], 1), (7, None, 1), (8, [1.0, None, 2.0], 1)]
    rows += [(9, [math.nan] * 3, 1), (9, [math.inf] * 3, 1), (11, [1.0, 2.0, 3.0], None)]
    want = _brute(rows, 10)
    assert len(want) > 1000 and _mined(spark, rows, 10) == want


def test_a_hot_vector_and_label(spark, small_steps):
    rng = np.random.default_rng(1)
    rows = [(i, [0.5, 0.25, -0.125] if i % 3 else [float(x) for x in rng.normal(size=3)], int(i % 4 == 0)) for i in range(300)]
    assert _mined(spark, rows, 50) == _brute(rows, 50)


def test_bounds_are_inclusive(spark):
    # Against the anchor (1): positives 100; negatives 30 and 90 are inside, 29 and 91 outside.
    rows = [(0, [1 / 256], 0), (1, [100 / 256], 0)] + [(10 + s, [s / 256], 1) for s in (29, 30, 31, 89, 90, 91)]
    got = [r for r in _mined(spark, rows, 100) if r[1] == 1]
    assert [(r[3], r[5]) for r in got] == [(100, 90), (99, 89), (41, 31), (40, 30)]


def test_planes_and_tables_give_the_product():
    rng = np.random.default_rng(2)
    values = rng.integers(-(2**20), 2**20, (50, 19))
    anchors = rng.integers(-300, 300, (6, 19))
    bits = int(hard_negatives.widths(values).max())
    planes = hard_negatives.bit_planes(values, bits)
    for kind in (np.int64, object):
        got = hard_negatives.products(hard_negatives.subset_tables(anchors, kind), planes)
        assert (got == values @ anchors.T).all()
    assert hard_negatives.widths(np.array([[0], [-1], [1], [-2], [127], [-128], [128]])).tolist() == [1, 1, 2, 2, 8, 8, 9]


def test_empty_table_and_no_anchor(spark):
    assert _mined(spark, [], 10) == []
    assert hard_negatives.mine(_frame(spark, [(1, [1.0], 1)]), F.lit(None).cast("boolean")).count() == 0
