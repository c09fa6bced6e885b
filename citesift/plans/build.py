"""Build the article table from retrieved, supplementary and labelled input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.operators import articles as ops
from citesift.operators import retrieval as ret
from citesift.session import durable
from citesift.sources.pages import Selector, with_fields

# Where the article pages keep their fields.
TITLE = Selector(css_class="heading-title")
ABSTRACT = Selector(element_id="enc-abstract")
TYPE_BUTTON = Selector("button", inside=Selector(element_id="publication-types"), path=("ul", "li", "div"))


def articles_from_pages(
    retrieved: DataFrame,
    pages: DataFrame,
    url_prefix: str,
    title: Selector = TITLE,
    abstract: Selector = ABSTRACT,
    types: Selector = TYPE_BUTTON,
) -> DataFrame:
    """Merge query results and extract their articles from fetched pages.

    ``retrieved``: ``search_term, term_idx, ord, pubmed_id, publication_date``;
    ``pages``: ``url, html``.
    """
    extracted = ret.extract_id_date(retrieved)
    found = ret.merge_queries(extracted, with_order=True).withColumn("url", ops.article_url(F.col("pubmed_id"), url_prefix))
    # Blocks stay apart, or the last word of one would run into the first of the next.
    fields = with_fields(pages, {"title": title, "abstract": abstract}, {"publication_types": types}, "\n")
    # Stored, or a later filter on titles is pushed below the scan and scans every page again.
    fields = durable(fields.drop("html"), "fields")
    return found.join(fields, "url").select(
        "url",
        "publication_date",
        "publication_types",
        "title",
        "abstract",
        # Text, like the keys of supplementary articles, but in the order of finding.
        F.format_string("%012d-%012d", "found.term_idx", "found.ord").alias("ord"),
    )


def build_articles(
    scraped: DataFrame, extra: DataFrame, relevant_titles: DataFrame, skip_titles: Sequence[str] = ()
) -> DataFrame:
    """Union with priority, dedup by title, dates, labels, drop empty abstracts.

    Labels are set on raw titles, before ``clean_text`` removes their brackets.
    """
    merged = ops.concat_sources(extra, scraped)
    unique = ops.dedup_by_title(merged, ("src_priority", "ord"), skip_titles)
    labelled = ops.label_by_title(ops.fix_dates(unique), relevant_titles)
    return ops.drop_missing_abstract(labelled).select(
        "url", "publication_date", "publication_types", "title", "abstract", "relevant"
    )


def prepare(articles: DataFrame, title_prefixes: Sequence[str] = ("corrigendum",)) -> DataFrame:
    """Clean and exclude, and key the rows by a number taken from the url."""
    cleaned = ops.exclude(ops.clean_text(articles), title_prefixes)
    return cleaned.withColumn("article_id", ops.id_from_url(F.col("url")).cast("bigint"))
