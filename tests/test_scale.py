"""Tasks grow in number with the rows, and costly scans run once."""

import json
import os

from pyspark.sql import functions as F

from citesift import session
from citesift.llm import pii
from citesift.plans.build import articles_from_pages
from citesift.registry import views
from citesift.sources import articles as files

SF_DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_dealt_over_the_partitions_of_the_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert views.texts(spark, SF_DIR).rdd.getNumPartitions() == 13
        assert views.records(spark, SF_DIR).rdd.getNumPartitions() == 13
        assert session.spread(spark.range(9), 3, "id").rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_ranked_table_is_written_by_several_tasks(spark, tmp_path):
    table = spark.range(60000).select((F.col("id") * 7919 % 60000 + 1).alias("rank"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("title"))
    files.write_ranked(table, str(tmp_path / "r"))
    names = sorted(n for n in os.listdir(tmp_path / "r") if n.startswith("part-"))
    assert len(names) > 1
    ranks = [json.loads(line)["rank"] for n in names for line in open(tmp_path / "r" / n)]
    assert ranks == list(range(1, 60001))


def test_a_filter_on_titles_scans_no_page_again(spark):
    retrieved = spark.createDataFrame([("q", 0, 1, "7", "2020-1-1")], "search_term string, term_idx int, ord long, pubmed_id string, publication_date string")
    pages = spark.createDataFrame([("u/7/", '<h1 class="heading-title">A title</h1><div id="enc-abstract">Text</div>')], "url string, html string")
    found = articles_from_pages(retrieved, pages, "u/").filter("title <> 'no'")
    assert [(r.title, r.abstract) for r in found.collect()] == [("A title", "Text")]
    # The scan cuts a page by this pattern.
    assert "regexp_extract_all" not in _plan(found)


def test_every_text_passes_the_prefilter_of_personal_data_once_more_only(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd now"), (2, "nothing here"), (None, None)], "doc_id long, text string")
    out = pii.replace_entities(docs, b"key")
    assert _plan(out).count("RLIKE") + _plan(out).count("rlike") == 1
    got = {r.doc_id: (r.text, r.n_entities) for r in out.collect()}
    assert got[2] == ("nothing here", 0) and got[None] == (None, 0) and got[1][1] == 1 and "a@b.cd" not in got[1][0]
