"""Counting and placing within a row, and the plans that follow from it."""

import collections

import pytest
from pyspark.sql import functions as F

from citesift.functions import text
from citesift.functions.arrays import counted_in_rows, positions_in_rows
from citesift.operators import articles as ops
from citesift.operators import features as feat
from citesift.operators.topics import topic_coherence, window_counts

DOCS = [["b", "a", "b", None, "c", "b"], [], None, ["x"], ["a"] * 50, ["", "a", ""]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "article_id long, tokens array<string>")


def test_counts_and_positions_within_rows(docs):
    counted = {r.article_id: r.c for r in counted_in_rows(docs, "tokens", "c").collect()}
    placed = {r.article_id: r.p for r in positions_in_rows(docs, "tokens", "p").collect()}
    some = {r.article_id: r.p for r in positions_in_rows(docs, "tokens", "p", lambda t: t.isin("a", "x")).collect()}
    for i, tokens in enumerate(DOCS):
        want = collections.Counter(t for t in tokens or [] if t is not None)
        where = {w: [k for k, t in enumerate(tokens or []) if t == w] for w in want}
        assert {x["value"]: x["n"] for x in counted[i] or []} == want
        assert {x["value"]: x["at"] for x in placed[i] or []} == where
        assert {x["value"]: x["at"] for x in some[i] or []} == {w: p for w, p in where.items() if w in "ax" and w}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counting_per_document_needs_no_exchange(spark, docs):
    assert "Exchange hash" not in _plan(feat.bigram_counts(docs))
    dictionary = spark.createDataFrame([("a", 1), ("b", 2)], "term string, df long")
    bag = feat.bag_of_words(docs, dictionary)
    assert "Exchange hash" not in _plan(bag)
    assert sorted(map(tuple, bag.collect())) == [(0, "a", 1), (0, "b", 3), (4, "a", 50), (5, "a", 1)]
    terms = {r.term: (r.df, r.tf) for r in feat.term_frequencies(docs, "tokens").collect()}
    assert terms == {"a": (3, 52), "b": (1, 3), "c": (1, 1), "x": (1, 1), "": (1, 2)}
    assert _plan(feat.term_frequencies(docs, "tokens")).count("Exchange hash") == 1


def test_window_counts_without_joins(spark, docs):
    topics = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "zz"), (1, "c")], "topic int, term string")
    pairs, total = window_counts(docs, topics, 3)
    got = {(r.topic, r.term_a, r.term_b): r.windows for r in pairs.collect()}
    windows = [tuple(d[i : i + 3]) for d in (DOCS[0], DOCS[4], DOCS[5]) for i in range(max(1, len(d) - 2))]
    both = lambda *w: sum(set(w) <= set(x) for x in windows)
    want = {(0, "a", "a"): both("a"), (0, "b", "b"): both("b"), (0, "a", "b"): both("a", "b")}
    want |= {(1, "b", "b"): both("b"), (1, "c", "c"): both("c"), (1, "b", "c"): both("b", "c")}
    assert got == want and total.first()[0] == len(windows)
    none, total = window_counts(docs, topics.limit(0))
    assert none.count() == 0 and total.first()[0] == 0
    # Where no topic word occurs there is nothing to go by.
    lone = spark.createDataFrame([(0, "nowhere"), (0, "never")], "topic int, term string")
    assert [r.coherence for r in topic_coherence(docs, lone).collect()] == [0.0]


def test_a_lexicon_table_gives_what_its_literal_gives(spark):
    articles = spark.createDataFrame(
        [(1, "Mice and MICE", "the children were running boxes\nmice"), (2, None, ""), (3, "x", "feet 12 geese")],
        "article_id long, title string, abstract string",
    )
    forms = list(text.IRREGULAR_FORMS.items())
    lexicon = spark.createDataFrame(forms + [("x", "y"), ("x", "z")], "form string, lemma string")
    want = {r.article_id: r.tokens for r in ops.build_records(articles).collect()} | {3: ["title_y", "foot", "geese"]}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (old, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            records = ops.build_records(articles, lexicon=lexicon, parts=3)
            assert {r.article_id: r.tokens for r in records.collect()} == want
        plan = _plan(records)
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_lemma_of_a_form_listed_twice_is_the_smallest(spark):
    records = spark.createDataFrame([(1, ["b", "a", "b"])], "article_id long, tokens array<string>")
    lexicon = spark.createDataFrame([("b", "q"), ("b", "p")], "form string, lemma string")
    assert ops.lemmatize_by_table(records, lexicon).first().tokens == ["p", "a", "p"]
    assert ops.lemmatize_by_table(records, lexicon.limit(0)).select(F.col("tokens")).first()[0] == ["b", "a", "b"]
