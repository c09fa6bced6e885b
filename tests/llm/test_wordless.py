"""Texts without words link with nothing, so each row of them stays."""

from citesift.llm import minhash_dedup


def test_wordless_rows_of_one_key_all_stay(spark):
    rows = [(None, None, "a"), (None, None, "b"), (1, " \n", "c"), (1, " \n", "d"), (2, "", "e"), (3, "x y", "f"), (3, "x y", "g"), (4, " ", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(r.source for r in minhash_dedup.without_near_duplicates(docs).collect())
    assert kept in (list("abcdefh"), list("abcdegh"))
