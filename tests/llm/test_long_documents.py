"""Contamination where the prefix table is too large for a broadcast."""

import re

import pytest

from citesift.llm import decontaminate


@pytest.fixture
def shuffled(spark):
    name, old = "spark.sql.autoBroadcastJoinThreshold", decontaminate.BROADCAST_WORDS
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    decontaminate.BROADCAST_WORDS = 0
    yield
    decontaminate.BROADCAST_WORDS = old
    spark.conf.set(name, before)


def test_same_hits_by_shuffle_and_no_whole_document_in_it(spark, shuffled, odd, empty):
    item = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, item), (2, "Short Item"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    words = " ".join(f"w{i} one" for i in range(30_000))
    docs = [(1, f"{words} {item} {words}"), (2, " ".join(item.split()[:9])), (3, "a short, item; b"), (4, f"{item} {item}"), (4, f"{item} {item}")]
    docs += [(None, item), (5, None), (6, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate.measured(docs, items).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, tuple(r["items"])) for r in rows)
    assert got == [
        (0, 12, 12, ("1",)), (1, 120_012, 12, ("1",)), (2, 9, 0, ()), (3, 4, 2, ("2",)),
        (4, 24, 24, ("1",)), (4, 24, 24, ("1",)), (5, 0, 0, ()), (6, 0, 0, ()),
    ]
    found = decontaminate.hits(docs, items)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    exchanges = [p for p in plan.split("\n\n") if re.match(r"\s*\(\d+\) Exchange", p)]
    assert exchanges and not any("ws#" in p or "text#" in p for p in exchanges)
    assert decontaminate.measured(odd, items).count() == odd.count()
    assert decontaminate.measured(empty, items).count() == 0
