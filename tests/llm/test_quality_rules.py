"""Repeats found by suffix arrays against repeats found by trying every substring."""

import collections
import random

import pytest

from citesift.llm import quality_rules, registry
from llm.conftest import LONG, ODD, SF_DIR


def _maximal(words, least):
    """Number of maximal repeats, the longest one, and the words they cover."""
    n, covered, longest, repeats = len(words), set(), 0, 0
    for size in range(least, n):
        places = collections.defaultdict(list)
        for i in range(n - size + 1):
            places[tuple(words[i : i + size])].append(i)
        for at in places.values():
            if len(at) < 2:
                continue
            longest = size
            covered.update(p for i in at for p in range(i, i + size))
            before = {words[i - 1] if i else None for i in at}
            after = {words[i + size] if i + size < n else None for i in at}
            repeats += len(before) > 1 and len(after) > 1
    return repeats, longest, len(covered)


def _again(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = collections.Counter(grams)
    return len({p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + 3)})


@pytest.mark.parametrize("least", [1, 2, 3, 4, 10])
def test_repeats_against_every_substring(monkeypatch, least):
    monkeypatch.setattr(quality_rules, "MIN_REPEAT", least)
    draw = random.Random(least)
    for _ in range(30):
        texts = []
        for _ in range(draw.randint(0, 6)):
            letters = "abcdefghijklmnopqrstuvwxyz"[: draw.choice([1, 2, 3, 26])]
            words = draw.choices(letters, k=draw.randint(0, 50))
            if draw.random() < 0.3:
                words = words + words[3:20] + words
            texts.append(" ".join(words))
        got = quality_rules._chunk(texts)
        for i, text in enumerate(texts):
            words = text.split()
            want = _maximal(words, least)
            assert (got["n_repeats"][i], got["longest_repeat"][i], got["n_covered"][i]) == want
            assert sum(b - a for a, b in got["spans"][i]) == want[2]
            assert got["n_repeat_words"][i] == _again(words)


def test_verdicts_by_hand(spark):
    words = [f"w{i}" for i in range(400)]
    copied = words + words[100:140]
    texts = [
        " ".join(words),
        " ".join(copied),
        " ".join(words + words[:51]),
        " ".join(words[:200] + words[:41] + ["x"]),
        "\n".join([" ".join(words[:60]), "a b", " ", "", "a b", "A b", "a b "]),
        " ".join(words[:49]),
        "#$ " + "ü " * 60,
        "a b c " * 40,
    ]
    rows = quality_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[i].kept for i in range(8)] == [True, True, False, False, True, False, False, False]
    assert [got[i].base_failed for i in range(8)] == [False, False, False, False, False, True, True, True]
    assert got[1].spans == [[100, 140], [400, 440]] and got[1].longest_repeat == 40 and got[1].n_repeats == 1
    assert got[4].n_dup_lines == 1 and got[4].n_repeat_words == 6
    assert (got[6].n_symbols, got[6].word_chars, got[6].n_words) == (2, 62, 61)
    assert got[7].n_covered == 120 and got[7].longest_repeat == 117


def test_odd_rows(spark, odd, empty):
    rows = quality_rules.measure(odd).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in rows) == sorted((i or 0, len((t or "").split())) for i, t in ODD)
    long_ones = [r for r in rows if r.doc_id in (4, 5)]
    # Ten words three thousand times over: all but one period repeats.
    assert [(r.longest_repeat, r.n_covered, r.kept) for r in long_ones] == [(len(LONG.split()) - 10, len(LONG.split()), False)] * 2
    assert quality_rules.measure(empty).count() == 0


def test_chunks_make_no_difference(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    whole = sorted(quality_rules.measure(docs).collect(), key=lambda r: r.doc_id)
    monkeypatch.setattr(quality_rules, "CHUNK", 300)
    assert sorted(quality_rules.measure(docs).collect(), key=lambda r: r.doc_id) == whole


def test_registered_query_has_the_stated_columns(spark):
    rows = registry.op12_quality_rules(spark, SF_DIR)
    assert rows.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
