"""Sources, retrieval, merging, labelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.operators import articles as ops
from citesift.operators import retrieval as ret
from citesift.plans import build
from citesift.registry import views
from citesift.session import scratch_path, spread
from citesift.sources import articles as files
from citesift.sources.pages import Selector, with_fields

TITLE, BODY, ITEM, AD = Selector("h1"), Selector("article"), Selector("li"), Selector(css_class="ad")
# An element that holds the others, and elements by their place.
PAGE, LINK = Selector("body"), Selector("a", inside=Selector("nav"), path=("ul", "li"))


def retrieve(spark, sf_dir) -> DataFrame:
    return ret.retrieve(views.texts(spark, sf_dir), views.QUERIES)


def _raw_records(spark, sf_dir) -> DataFrame:
    """Retrieved records as a service returns them: ids of several lines, two records
    per id, empty ids, missing dates."""
    docs = views.table(spark, sf_dir, "documents")
    date = F.expr("date_add(date'2019-10-01', cast(doc_id % 365 as int))")
    pubmed_id = F.expr(r"case when source = 'src7' then '' else concat(doc_id div 2, '\n', doc_id) end")
    found = ret.retrieve(views.texts(spark, sf_dir), views.QUERIES)
    return found.join(docs.select("doc_id", "lang", "source"), "doc_id").select(
        "search_term",
        "term_idx",
        F.col("doc_id").alias("ord"),
        pubmed_id.alias("pubmed_id"),
        F.when(F.col("lang") != "de", F.concat_ws("-", F.year(date), F.month(date), F.dayofmonth(date))).alias(
            "publication_date"
        ),
    )


def extract_id_date(spark, sf_dir) -> DataFrame:
    return ret.extract_id_date(_raw_records(spark, sf_dir))


def merge_queries(spark, sf_dir) -> DataFrame:
    return ret.merge_queries(extract_id_date(spark, sf_dir))


def retrieval_counts(spark, sf_dir) -> DataFrame:
    return ret.retrieval_counts(extract_id_date(spark, sf_dir))


def retrieval_ends(spark, sf_dir) -> DataFrame:
    return ret.retrieval_ends(extract_id_date(spark, sf_dir))


def html_fields(spark, sf_dir) -> DataFrame:
    fields = {"title": TITLE, "abstract": BODY, "note": AD, "body": PAGE}
    return with_fields(views.table(spark, sf_dir, "pages"), fields).select("page_id", *fields)


def html_list(spark, sf_dir) -> DataFrame:
    lists = {"publication_types": ITEM, "links": LINK}
    return with_fields(views.table(spark, sf_dir, "pages"), {}, lists).select("page_id", *lists)


def article_url(spark, sf_dir) -> DataFrame:
    url = ops.article_url(F.col("doc_id"), views.URL_PREFIX)
    docs = views.table(spark, sf_dir, "documents").select("doc_id", url.alias("url"))
    return docs.withColumn("id_from_url", ops.id_from_url(F.col("url")))


def json_map_source(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "json-map")
    files.write_json_map(views.articles(spark, sf_dir, False), path, objects=True)
    return files.read_json_map(spark, path)


def label_file_source(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "titles")
    files.write_label_file(views.articles(spark, sf_dir).filter("relevant = 1").select("title").distinct(), path)
    return files.read_label_file(spark, path)


def _two_sources(spark, sf_dir) -> DataFrame:
    """Labelled articles play the supplementary source, all articles the main one."""
    rows = views.articles(spark, sf_dir).select("article_id", "url", "title", F.col("article_id").alias("ord"), "relevant")
    return ops.concat_sources(rows.filter("relevant is not null"), rows)


def concat_sources(spark, sf_dir) -> DataFrame:
    return _two_sources(spark, sf_dir)


def dedup_by_title(spark, sf_dir) -> DataFrame:
    return ops.dedup_by_title(_two_sources(spark, sf_dir), skip=("Eauouon.",))


def dedup_by_title_ignore_case(spark, sf_dir) -> DataFrame:
    return ops.dedup_by_title(_two_sources(spark, sf_dir), ignore_case=True)


def fix_dates(spark, sf_dir) -> DataFrame:
    day = F.col("publication_date")
    raw = F.when(F.col("lang") == "es", F.year(day).cast("string")).otherwise(
        F.concat_ws("-", F.year(day), F.month(day), F.dayofmonth(day))
    )
    rows = views.articles(spark, sf_dir, False).select("article_id", "lang", day)
    return ops.fix_dates(rows.select("article_id", raw.alias("publication_date")))


def label_by_title(spark, sf_dir) -> DataFrame:
    rows = views.articles(spark, sf_dir)
    listed = rows.filter("relevant = 1").select("title")
    return ops.label_by_title(rows.select("article_id", "title"), listed).select("article_id", "relevant")


def drop_missing_abstract(spark, sf_dir) -> DataFrame:
    return ops.drop_missing_abstract(views.articles(spark, sf_dir, False)).select("article_id", "abstract")


def article_table(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "articles")
    files.write_articles(views.articles(spark, sf_dir), path)
    return files.read_articles(spark, path)


def _pages(spark, sf_dir) -> DataFrame:
    """The articles as a service shows them: title, abstract and publication types in elements."""

    def shown(text) -> Column:
        for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(character), F.lit(entity))
        return text

    kinds = F.filter(F.split("publication_types", ";"), lambda t: t != "")
    buttons = F.transform(kinds, lambda t: F.concat(F.lit("<li><div><button>"), shown(t), F.lit("</button></div></li>")))
    html = F.concat(
        F.lit('<body><button>Share</button><h1 class="large heading-title">'), shown(F.col("title")),
        F.lit('</h1><div><div id="enc-abstract"><div><p>'), shown(F.col("abstract")),
        F.lit('</p></div></div></div><div id="publication-types"><h3>Types</h3><ul>'), F.array_join(buttons, ""),
        F.lit("</ul></div><ul><li><div><button>Cite</button></div></li></ul></body>"),
    )
    return spread(views.articles(spark, sf_dir), views.PARTS, "article_id").select("url", html.alias("html"))


def build_articles(spark, sf_dir) -> DataFrame:
    """The build job: records merged, pages read, a supplementary source, first titles, labels."""
    scraped = build.articles_from_pages(_raw_records(spark, sf_dir), _pages(spark, sf_dir), views.URL_PREFIX)
    listed = views.articles(spark, sf_dir).filter("relevant = 1")
    extra = listed.select(
        "url", F.col("publication_date").cast("string").alias("publication_date"), "publication_types", "title", "abstract",
        F.col("article_id").cast("string").alias("ord"),
    )
    return build.build_articles(scraped, extra, listed.select("title"), ("Eauouon.",))


def class_counts(spark, sf_dir) -> DataFrame:
    counts = ops.class_counts(views.articles(spark, sf_dir))
    return counts.withColumn("prevalence", F.round("prevalence", 6))


QUERIES = {
    "retrieve": retrieve,
    "extract_id_date": extract_id_date,
    "merge_queries": merge_queries,
    "retrieval_counts": retrieval_counts,
    "retrieval_ends": retrieval_ends,
    "html_fields": html_fields,
    "html_list_field": html_list,
    "article_url": article_url,
    "json_map_source": json_map_source,
    "label_file_source": label_file_source,
    "concat_sources": concat_sources,
    "dedup_by_title": dedup_by_title,
    "dedup_by_title_ignore_case": dedup_by_title_ignore_case,
    "fix_dates": fix_dates,
    "label_by_title": label_by_title,
    "drop_missing_abstract": drop_missing_abstract,
    "article_table": article_table,
    "class_counts": class_counts,
    "build_articles": build_articles,
}

_RETRIEVED = f"""
toks as (select doc_id, lang, source, {views.sql_tokens('text')} as t from documents),
retrieved as (
  select 'the AND (und OR der)' as search_term, 0 as term_idx, * from toks
    where list_contains(t, 'the') and (list_contains(t, 'und') or list_contains(t, 'der'))
  union all
  select 'la AND de', 1, * from toks where list_contains(t, 'la') and list_contains(t, 'de')
  union all
  select 'the AND (with OR therou*)', 2, * from toks
    where list_contains(t, 'the')
      and (list_contains(t, 'with') or len(list_filter(t, lambda x: starts_with(x, 'therou'))) > 0)
  union all
  select 'of AND tion', 3, * from toks where list_contains(t, 'of') and list_contains(t, 'tion')
  union all
  select 'en AND (le OR es OR on)', 4, * from toks
    where list_contains(t, 'en') and (list_contains(t, 'le') or list_contains(t, 'es') or list_contains(t, 'on')))"""

_EXTRACTED = (
    _RETRIEVED
    + """,
raw as (
  select search_term, term_idx, doc_id as ord,
         case when source = 'src7' then '' else concat(doc_id // 2, chr(10), doc_id) end as pubmed_id,
         case when lang <> 'de' then concat(year(d), '-', month(d), '-', day(d)) end as publication_date
  from (select *, cast(date '2019-10-01' + cast(doc_id % 365 as int) as date) as d from retrieved)),
lined as (select search_term, term_idx, ord, split_part(pubmed_id, chr(10), 1) as pubmed_id,
                 coalesce(publication_date, '') as publication_date from raw where pubmed_id <> ''),
extracted as (
  select search_term, term_idx, pubmed_id, first_ord as ord, publication_date
  from (select *, min(ord) over (partition by term_idx, pubmed_id) as first_ord,
               row_number() over (partition by term_idx, pubmed_id order by ord desc) as rn from lined)
  where rn = 1)"""
)

_MERGED = """
merged as (
  select pubmed_id, publication_date, first_term, first_ord from (
    select e.*, row_number() over (partition by pubmed_id order by term_idx desc) as rn,
           first_value(term_idx) over (partition by pubmed_id order by term_idx, ord) as first_term,
           first_value(ord) over (partition by pubmed_id order by term_idx, ord) as first_ord
    from extracted e) where rn = 1)"""

_DECODED = (
    "replace(replace(replace(replace(replace(replace({x}, "
    "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
)


def _elements(fields: dict[str, str], after: str = "") -> str:
    """Texts of elements, from the running number of open elements of each name.

    ``fields`` gives for every column the condition of an opening tag on its ``name``
    and ``tag``; each text is followed by ``after``.
    """
    picked = "\n  union all\n".join(
        f"  select '{field}' as field, r, name, d, pos as s from counted where not closes and {wanted}"
        for field, wanted in fields.items()
    )
    columns = ", ".join(
        f"coalesce(string_agg(text || '{after}', '' order by s) filter (field = '{field}'), '') as {field}" for field in fields
    )
    return f"""with cleaned as (
  select row_number() over () as r, page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
    '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') as html from pages),
pieces as (select r, unnest(range(len(p))) as pos, unnest(p) as piece from (select r, string_split(html, '<') as p from cleaned)),
parts as (
  select r, pos, case when pos > 0 then split_part(piece, '>', 1) else '' end as tag,
    case when pos > 0 then substr(piece, strpos(piece, '>') + 1) else piece end as text from pieces),
counted as (
  select *, sum(case when closes then -1 else 1 end) over (partition by r, name order by pos) as d
  from (select r, pos, tag, starts_with(tag, '/') as closes, lower(split_part(ltrim(tag, '/'), ' ', 1)) as name from parts)),
opened as (
{picked}),
ended as (
  select o.field, o.r, o.s, min(e.pos) as e
  from opened o left join counted e on e.r = o.r and e.name = o.name and e.closes and e.pos > o.s and e.d = o.d - 1
  group by all),
texts as (
  select field, r, s, string_agg({_DECODED.format(x='p.text')}, '' order by p.pos) as text
  from ended join parts p using (r) where p.pos >= s and (e is null or p.pos < e) group by all)
select page_id, {columns} from cleaned left join texts using (r) group by r, page_id"""


_SOURCES = (
    views.SQL_ARTICLES
    + """,
sources as (
  select article_id, url, title, article_id as ord, relevant, 0 as src_priority from articles where relevant is not null
  union all
  select article_id, url, title, article_id, relevant, 1 from articles)"""
)


def _dedup(key: str, where: str) -> str:
    return f"""with {_SOURCES}
select article_id, url, title, ord, relevant, src_priority from (
  select *, row_number() over (partition by {key} order by src_priority, ord) as rn from sources {where}) where rn = 1"""


ORACLE = {
    "retrieve": f"with {_RETRIEVED} select search_term, cast(term_idx as int) as term_idx, doc_id from retrieved",
    "extract_id_date": f"""with {_EXTRACTED}
select search_term, cast(term_idx as int) as term_idx, pubmed_id, publication_date, ord from extracted""",
    "merge_queries": f"with {_EXTRACTED}, {_MERGED} select pubmed_id, publication_date from merged",
    "retrieval_counts": f"""with {_EXTRACTED}
select search_term, cast(term_idx as int) as term_idx, count(*) as articles from extracted group by 1, 2
union all select 'unique', -1, count(distinct pubmed_id) from extracted""",
    "retrieval_ends": f"""with {_EXTRACTED}, {_MERGED}
select pubmed_id, publication_date, cast(first_term as int) as term_idx, first_ord as ord, 'first' as part from (
  select *, row_number() over (order by first_term, first_ord) as r from merged) where r <= 3
union all
select pubmed_id, publication_date, cast(first_term as int), first_ord, 'last' from (
  select *, row_number() over (order by first_term desc, first_ord desc) as r from merged) where r <= 3""",
    "html_fields": _elements(
        {"title": "name = 'h1'", "abstract": "name = 'article'", "note": "tag like '% class=\"ad\"'", "body": "name = 'body'"}
    ),
    # All links of the pages stand in list items of their navigation.
    "html_list_field": _elements({"publication_types": "name = 'li'", "links": "name = 'a'"}, ";"),
    "article_url": f"""select doc_id, concat('{views.URL_PREFIX}', doc_id, '/') as url,
  cast(doc_id as varchar) as id_from_url from documents""",
    "json_map_source": f"""with {views.SQL_ARTICLES}
select cast(article_id as varchar) as article_key, url, cast(publication_date as varchar) as publication_date,
  publication_types, title, abstract from articles""",
    "label_file_source": f"""with {views.SQL_ARTICLES}
select distinct title from articles where relevant = 1""",
    "concat_sources": f"with {_SOURCES} select * from sources",
    "dedup_by_title": _dedup("title", "where title <> 'Eauouon.'"),
    "dedup_by_title_ignore_case": _dedup("lower(title)", ""),
    "fix_dates": f"""with {views.SQL_ARTICLES}
select article_id, case when lang = 'es' then make_date(year(publication_date), 1, 1) else publication_date end
  as publication_date from articles""",
    "label_by_title": f"""with {views.SQL_ARTICLES}
select article_id, cast(title in (select title from articles where relevant = 1) as int) as relevant from articles""",
    "drop_missing_abstract": f"""with {views.SQL_ARTICLES}
select article_id, abstract from articles where abstract <> ''""",
    "article_table": f"""with {views.SQL_ARTICLES}
select url, publication_date, publication_types, title, abstract, relevant from articles""",
    "class_counts": f"""with {views.SQL_ARTICLES}
select count(*) as articles, cast(sum(coalesce(relevant, 0)) as bigint) as relevant,
  round(avg(coalesce(relevant, 0)), 6) as prevalence from articles""",
    # Blanks around a paragraph are not shown.
    "build_articles": f"""with {views.SQL_ARTICLES}, {_EXTRACTED.replace("raw as", "raw as materialized")}, {_MERGED},
main as (
  select a.url, try_cast(nullif(m.publication_date, '') as date) as publication_date, a.publication_types, a.title,
    regexp_replace(a.abstract, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') as abstract, 1 as priority,
    printf('%012d-%012d', first_term, first_ord) as ord
  from merged m join articles a on a.article_id = cast(m.pubmed_id as bigint)),
together as (
  select * from main union all
  select url, publication_date, publication_types, title, abstract, 0, cast(article_id as varchar) from articles where relevant = 1),
firsts as (
  select *, row_number() over (partition by title order by priority, ord) as place from together where title <> 'Eauouon.')
select url, publication_date, publication_types, title, abstract,
  cast(title in (select title from articles where relevant = 1) as int) as relevant
from firsts where place = 1 and abstract <> ''""",
}
