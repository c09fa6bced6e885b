"""Hand-made rows for retrieval, sources, cleaning and text."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from citesift.functions import text
from citesift.operators import articles as ops
from citesift.operators import retrieval as ret
from citesift.operators.retrieval import Query
from citesift.plans.build import articles_from_pages, build_articles, prepare
from citesift.sources import articles as files
from citesift.sources.pages import Selector, element_texts, html_field, html_list_field, with_fields


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_phrases_wildcards_and_case(spark):
    docs = spark.createDataFrame(
        [(1, "Dasatinib: SIDE\neffects seen"), (2, "dasatinib side-effect"), (3, "upside effect of dasatinib"), (4, None)],
        "doc_id long, text string",
    )
    query = Query("q", (("Dasatinib",), ("side effect*", "risk")))
    assert rows(ret.retrieve(docs, [query]), "doc_id") == [(1,), (2,)]
    exact = Query("q", (("side effect",),))
    assert rows(ret.retrieve(docs, [exact]), "doc_id") == [(2,)]


def test_result_limit_is_per_query(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(10)], "doc_id long, text string")
    queries = [Query("a", (("a",),)), Query("b", (("b",),))]
    limited = ret.retrieve(docs, queries, max_results=3)
    assert rows(limited, "term_idx", "doc_id") == [(t, i) for t in (0, 1) for i in range(3)]


def test_ids_and_dates_last_record_wins(spark):
    raw = spark.createDataFrame(
        [
            ("a", 0, 1, "7\n8", "2019-1-1"),
            ("a", 0, 2, "7", None),
            ("b", 1, 1, "7", "2020-2-2"),
            ("b", 1, 2, "", "2020-2-2"),
            ("b", 1, 3, None, "2020-2-2"),
        ],
        "search_term string, term_idx int, ord int, pubmed_id string, publication_date string",
    )
    extracted = ret.extract_id_date(raw)
    assert rows(extracted, "term_idx", "pubmed_id", "publication_date") == [(0, "7", ""), (1, "7", "2020-2-2")]
    assert rows(ret.merge_queries(extracted), "pubmed_id", "publication_date") == [("7", "2020-2-2")]
    counts = ret.retrieval_counts(extracted)
    assert rows(counts, "term_idx", "articles") == [(-1, 1), (0, 1), (1, 1)]


def test_html_selectors(spark):
    page = (
        '<h1 class="x heading-title"> A &lt;b&gt; <i>c</i></h1><div id="enc-abstract"><p>One</p> two &amp;lt;</div>'
        "<h1 class='heading-title-2'>no</h1><ul><li><button>Review</button></li><li><button>Trial</button></li></ul>"
    )
    df = spark.createDataFrame([(page,), ("<p>none</p>",)], "html string")
    got = df.select(
        html_field(F.col("html"), Selector(css_class="heading-title")).alias("t"),
        html_field(F.col("html"), Selector(element_id="enc-abstract")).alias("a"),
        html_list_field(F.col("html"), Selector("button")).alias("k"),
    ).collect()
    assert tuple(got[0]) == (" A <b> c", "One two &lt;", "Review;Trial;")
    assert tuple(got[1]) == ("", "", "")


def test_url_and_id(spark):
    df = spark.createDataFrame([(42,)], "i long").select(ops.article_url(F.col("i"), "https://x.org/").alias("u"))
    assert rows(df.select("u", ops.id_from_url(F.col("u")).alias("i")), "u", "i") == [("https://x.org/42/", "42")]


def test_dates(spark):
    df = spark.createDataFrame([("2015",), ("2015-3-7",), ("2015-13-1",), ("",), (None,)], "publication_date string")
    got = [r[0] for r in ops.fix_dates(df).collect()]
    assert got == [dt.date(2015, 1, 1), dt.date(2015, 3, 7), None, None, None]


ARTICLE = "url string, publication_date string, publication_types string, title string, abstract string"


def test_build_from_two_sources(spark):
    extra = spark.createDataFrame(
        [("https://x.org/1/", "2015", "Review;", "[Hepatic events]", "first\nline", 1)], ARTICLE + ", ord long"
    )
    scraped = spark.createDataFrame(
        [
            ("https://x.org/2/", "2016-1-2", "", "[Hepatic events]", "second", 1),
            ("https://x.org/3/", "2016-1-2", "", "Crohn's disease", "", 2),
            ("https://x.org/4/", "2016-1-2", "", "hepatic Events", None, 3),
            ("https://x.org/5/", "2016-1-2", "", "Imatinib Mesylate", "dropped by name", 4),
            ("https://x.org/6/", "2016-1-2", "", "Imatinib mesylate", "kept", 5),
            ("https://x.org/7/", "2016-1-2", "", "Corrigendum: x", "gone", 6),
        ],
        ARTICLE + ", ord long",
    )
    titles = spark.createDataFrame([("[Hepatic events]",), ("[Hepatic events]",)], "title string")
    table = build_articles(scraped, extra, titles, ("Imatinib Mesylate",))
    assert rows(table, "url", "relevant") == [
        ("https://x.org/1/", 1), ("https://x.org/6/", 0), ("https://x.org/7/", 0)
    ]
    clean = prepare(table)
    assert rows(clean, "article_id", "title", "abstract") == [
        (1, "Hepatic events", "first line"), (6, "Imatinib mesylate", "kept")
    ]


def test_articles_from_pages(spark):
    retrieved = spark.createDataFrame(
        [("q", 0, 1, "9", "2020")],
        "search_term string, term_idx int, ord int, pubmed_id string, publication_date string",
    )
    html = '<h1 class="heading-title">T</h1><div id="enc-abstract">A</div><button>Share</button>'
    html += '<div class="k" id="publication-types"><h3>Types</h3><ul><li><div><button>Review</button></div></li>'
    html += "<li><div><button>Case Reports</button></div></li></ul></div><ul><li><button>Cite</button></li></ul>"
    pages = spark.createDataFrame([("https://x.org/9/", html)], "url string, html string")
    found = articles_from_pages(retrieved, pages, "https://x.org/")
    assert rows(found, "url", "title", "abstract", "publication_types") == [("https://x.org/9/", "T", "A", "Review;Case Reports;")]


def test_dedup_keeps_map_side_limit_and_hot_title(spark):
    many = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("title"),
        F.col("id").alias("ord"),
        F.lit(1).alias("src_priority"),
    )
    unique = ops.dedup_by_title(many)
    assert unique.count() == 2001
    assert unique.filter("title = 'hot'").first()["ord"] == 0
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_unique_check(spark):
    df = spark.createDataFrame([("u1", "a"), ("u2", "a")], "url string, abstract string")
    assert rows(ops.check_unique(df), "checked", "n_rows", "n_distinct", "is_unique") == [
        ("abstract", 2, 1, False), ("url", 2, 2, True)
    ]
    with pytest.raises(ValueError, match="abstract"):
        ops.check_unique(df, raise_on_duplicate=True)


def test_split_is_strict(spark):
    df = spark.createDataFrame([(dt.date(2020, 4, 16),), (dt.date(2020, 4, 17),)], "publication_date date")
    old, new = ops.temporal_split(df)
    assert [r[0].day for r in old.collect()] == [16] and [r[0].day for r in new.collect()] == [17]


def test_tokens_filter_and_base_forms(spark):
    df = spark.createDataFrame([("The 2 studies were USING mice,\nclasses of boxes; status treated_1 __ 12_3",)], "t string")
    got = df.select(text.lemmas(F.col("t"))).first()[0]
    assert got == ["study", "use", "mouse", "class", "box", "status", "treated_1"]


def test_bigrams_of_short_documents(spark):
    df = spark.createDataFrame([(["a"],), ([],), (["ab"],), (["ab", "c", "de", "fg"],)], "tokens array<string>")
    got = [r[0] for r in text.add_bigrams(df, "b").select("b").collect()]
    assert got == [[], [], [], ["ab de", "de fg"]]


def test_files(spark, tmp_path):
    table = spark.createDataFrame(
        [("https://x.org/1/", dt.date(2015, 1, 1), "Review;", "[T's] x", "a\nb", 1),
         ("https://x.org/2/", None, None, 'say "y"', None, None)],
        files.ARTICLE_SCHEMA,
    )
    files.write_articles(table, str(tmp_path / "table"))
    back = files.read_articles(spark, str(tmp_path / "table"))
    assert back.dtypes == table.dtypes
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in table.collect()}

    whole = tmp_path / "extra.json"
    article = {"url": "u", "publication_date": "2015", "publication_types": "", "title": "T", "abstract": "A"}
    whole.write_text(json.dumps({"1": article, "2": article}, indent=1))
    assert rows(files.read_json_map(spark, str(whole)), "article_key", "title") == [("1", "T"), ("2", "T")]

    titles = table.select("title")
    files.write_label_file(titles, str(tmp_path / "titles"))
    assert rows(files.read_label_file(spark, str(tmp_path / "titles")), "title") == rows(titles, "title")


def test_own_tagger_replaces_the_built_in_one(spark):
    df = spark.createDataFrame([(1, "A B", "c D"), (2, "", None)], "article_id long, title string, abstract string")
    got = ops.build_records(df, tagger=lambda texts: texts.fillna("").str.lower().str.split())
    assert rows(got, "article_id", "tokens") == [(1, ["title_a", "title_b", "c", "d"]), (2, [])]


def test_jobs(spark, tmp_path, monkeypatch):
    """The three jobs one after the other, from records and pages to ranked tables."""
    from citesift import __main__ as jobs

    n = 120
    records = [("q", 0, i, f"{i}\n9{i}", f"20{19 + i % 2}-5-{1 + i % 28}") for i in range(n)]
    words = lambda i: "alpha risk" if i % 4 == 0 else "beta gamma"
    pages = [
        (f"https://x.org/{i}/",
         f'<h1 class="heading-title">Study {i} {words(i)}</h1><div id="enc-abstract">text {i} {words(i)}</div>')
        for i in range(n)
    ]
    schema = "search_term string, term_idx int, ord int, pubmed_id string, publication_date string"
    spark.createDataFrame(records, schema).write.parquet(str(tmp_path / "retrieved"))
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "titles.csv").write_text("title\n" + "\n".join(f"Study {i} {words(i)}" for i in range(0, n, 8)) + "\n")
    (tmp_path / "queries.json").write_text(json.dumps([["q", [["alpha"], ["risk*"]]]]))

    def run(*args):
        monkeypatch.setattr("sys.argv", ["citesift", *map(str, args)])
        jobs.main()

    run("build", "--retrieved", tmp_path / "retrieved", "--pages", tmp_path / "pages", "--url-prefix", "https://x.org/",
        "--titles", tmp_path / "titles.csv", "--out", tmp_path / "table")
    table = files.read_articles(spark, str(tmp_path / "table"))
    assert (table.count(), table.filter("relevant = 1").count()) == (n, n // 8)
    common = ("--articles", tmp_path / "table", "--queries", tmp_path / "queries.json")
    run("evaluate", *common, "--grid-points", 2, "--out", tmp_path / "report")
    assert spark.read.parquet(str(tmp_path / "report/scores")).count() == n // 2
    run("update", *common, "--grid-points", 2, "--out", tmp_path / "tables")
    assert spark.read.json(str(tmp_path / "tables/new_articles")).count() == n // 2


def test_the_article_found_first_stays(spark):
    found = [("q", 0, 0, "9", "2020-1-1"), ("q", 0, 1, "10", "2020-1-1"), ("r", 1, 0, "10", "2020-2-1")]
    extracted = spark.createDataFrame(found, "search_term string, term_idx int, ord int, pubmed_id string, publication_date string")
    merged = ret.merge_queries(extracted, with_order=True)
    titled = merged.selectExpr("pubmed_id", "'same' as title", "found as ord", "1 as src_priority")
    assert [r.pubmed_id for r in ops.dedup_by_title(titled).collect()] == ["9"]


def test_a_date_range_reads_its_year_folders_only(spark, tmp_path):
    rows = [(str(y), dt.date(y, 6, 1), "", "t", "a", 0) for y in (2018, 2019, 2020)] + [("none", None, "", "t", "a", 0)]
    files.write_articles(spark.createDataFrame(rows, files.ARTICLE_SCHEMA), str(tmp_path / "t"))
    some = files.read_articles(spark, str(tmp_path / "t"), dt.date(2019, 1, 1), dt.date(2020, 6, 1))
    assert [r.url for r in some.collect()] == ["2019"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert files.read_articles(spark, str(tmp_path / "t")).count() == 4


def _texts(spark, html, selector, between_blocks=""):
    df = spark.createDataFrame([(html,)], "html string")
    return df.select(element_texts(F.col("html"), selector, between_blocks)).first()[0]


def test_an_element_ends_at_its_own_closing_tag(spark):
    abstract = Selector(element_id="enc-abstract")
    nested = '<div><div id="enc-abstract"><div>first part</div><div>second part</div></div><div>other</div></div>'
    assert _texts(spark, nested, abstract) == ["first partsecond part"]
    assert _texts(spark, nested, abstract, "\n") == ["first part\nsecond part"]
    # An element within another of its kind counts for itself, too; order is that of their beginnings.
    twice = '<div class="a b">x<div class="b">y</div>z</div><div class="b">w</div><div class="ab">v</div>'
    assert _texts(spark, twice, Selector(css_class="b")) == ["xyz", "y", "w"]


def test_unclosed_elements_end_where_html_ends_them(spark):
    items = "<ul><li>a<ul><li>b<li>c</ul><li>d<p>e<p>f</ul>g<p>h<div>i</div>"
    assert _texts(spark, items, Selector("li")) == ["abc", "b", "c", "def"]
    assert _texts(spark, items, Selector("p")) == ["e", "f", "h"]
    # The end of an element ends what is open inside; a closing tag of nothing is passed over.
    assert _texts(spark, "<article><b>x<i>y</article>z</i></b>", Selector("b")) == ["xy"]
    assert _texts(spark, "<table><tr><td>1<td>2<tr><td>3</table>", Selector("td")) == ["1", "2", "3"]
    assert _texts(spark, "<b>never closed <i>x", Selector("b")) == ["never closed x"]


def test_comments_scripts_and_attribute_values_are_no_elements(spark):
    html = (
        '<div title="<p>no</p> id=\'t\'" id=t>a<!-- <p>no</p> --><script>var x = "</div><p>";</script>'
        "<style>p{}</style><br/>b <img alt='>'>1 < 2 &amp;lt;<input class='k'></div><p>after</p>"
    )
    assert _texts(spark, html, Selector(element_id="t")) == ["ab 1 < 2 &lt;"]
    assert _texts(spark, html, Selector(element_id="t"), "\n") == ["a\nb 1 < 2 &lt;"]
    assert _texts(spark, html, Selector("p")) == ["after"]
    assert _texts(spark, html, Selector("input", "k")) == [""]
    assert _texts(spark, "", Selector("p")) == [] and _texts(spark, "plain", Selector("p")) == []


def test_elements_by_place(spark):
    html = '<ul><li><div><button>no</button></div></li></ul><section id="t"><button>no path</button><ul><li><div>'
    html += "<button>a <b>b</b></button><p><button>deeper</button></p></div></li></ul></section>"
    place = Selector(element_id="t")
    assert _texts(spark, html, Selector("button", inside=place, path=("ul", "li", "div"))) == ["a b"]
    assert _texts(spark, html, Selector("button", inside=place)) == ["no path", "a b", "deeper"]


def test_a_page_is_cut_once_for_all_fields(spark):
    pages = spark.createDataFrame([("<h1>a</h1><p>b</p><li>c</li><li>d",)], "html string")
    found = with_fields(pages, {"t": Selector("h1"), "p": Selector("p")}, {"k": Selector("li")})
    assert tuple(found.first()) == ("<h1>a</h1><p>b</p><li>c</li><li>d", "a", "b", "c;d;")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
