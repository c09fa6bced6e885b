"""The article table: union, dedup, dates, labels, cleaning, checks, split."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.functions.arrays import exploded, positions_in_rows
from citesift.functions.text import TITLE_PREFIX, filter_tokens, lemmas, prefix_title, suffix_rules, tokenize
from citesift.session import spread

# Fixed value: articles from this day on are new.
CUTOFF_DATE = dt.date(2020, 4, 17)


def article_url(article_id: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), article_id.cast("string"), F.lit("/"))


def id_from_url(url: Column) -> Column:
    return F.try_element_at(F.split(url, "/"), F.lit(-2))


def concat_sources(extra: DataFrame, main: DataFrame) -> DataFrame:
    """Supplementary rows take precedence: they carry the lower ``src_priority``."""
    return extra.withColumn("src_priority", F.lit(0)).unionByName(
        main.withColumn("src_priority", F.lit(1)), allowMissingColumns=True
    )


def dedup_by_title(
    articles: DataFrame,
    order: Sequence[str] = ("src_priority", "ord"),
    skip: Sequence[str] = (),
    ignore_case: bool = False,
) -> DataFrame:
    """The first article of every title, without the titles listed in ``skip``.

    ``row_number() = 1`` is planned with a map-side group limit, so each map task
    ships at most one article per title however often a title occurs.
    """
    key = F.lower("title") if ignore_case else F.col("title")
    kept = articles.filter(F.col("title").isNull() | ~F.col("title").isin(list(skip))) if skip else articles
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return kept.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


def fix_dates(articles: DataFrame, column: str = "publication_date") -> DataFrame:
    """``y-m-d`` text to a date; a bare year becomes January 1st."""
    raw = F.col(column)
    year = F.when(~raw.contains("-"), raw.try_cast("int"))
    return articles.withColumn(
        column, F.coalesce(F.try_to_date(raw, "yyyy-M-d"), F.make_date(year, F.lit(1), F.lit(1)))
    )


def label_by_title(articles: DataFrame, relevant_titles: DataFrame) -> DataFrame:
    """``relevant`` = 1 if the raw title is listed.

    No broadcast hint: the planner broadcasts the list only while its measured
    size is under ``spark.sql.autoBroadcastJoinThreshold``, and beyond that the
    shuffled join splits a hot title at run time.
    """
    listed = relevant_titles.select("title").distinct().withColumn("_listed", F.lit(1))
    return (
        articles.join(listed, "title", "left")
        .withColumn("relevant", F.coalesce("_listed", F.lit(0)))
        .drop("_listed")
    )


def drop_missing_abstract(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("abstract") != "")


def class_counts(articles: DataFrame) -> DataFrame:
    return articles.agg(
        F.count("*").alias("articles"),
        F.sum(F.coalesce("relevant", F.lit(0))).cast("long").alias("relevant"),
        F.avg(F.coalesce("relevant", F.lit(0)).cast("double")).alias("prevalence"),
    )


def clean_text(articles: DataFrame) -> DataFrame:
    """Square brackets leave the title, newlines in the abstract become spaces."""
    return articles.withColumn("title", F.translate("title", "[]", "")).withColumn(
        "abstract", F.translate("abstract", "\n", " ")
    )


def exclude(articles: DataFrame, title_prefixes: Sequence[str] = ("corrigendum",)) -> DataFrame:
    title = F.lower(F.coalesce("title", F.lit("")))
    for prefix in title_prefixes:
        articles = articles.filter(~title.startswith(prefix.lower()))
    return articles


def check_unique(
    articles: DataFrame, columns: Sequence[str] = ("url", "abstract"), raise_on_duplicate: bool = False
) -> DataFrame:
    """Rows against distinct values, one row per column.

    Values are compared by SHA-256, so the shuffle carries 32 bytes per value
    instead of whole abstracts; each column is pre-aggregated on the map side.
    """
    report = None
    for name in columns:
        digest = F.unhex(F.sha2(F.col(name).cast("binary"), 256))
        copies = articles.groupBy(digest.alias("_v")).agg(F.count("*").alias("_n"))
        row = copies.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
            F.count("*").alias("n_distinct"),
        ).select(
            F.lit(name).alias("checked"),
            "n_rows",
            "n_distinct",
            (F.col("n_rows") == F.col("n_distinct")).alias("is_unique"),
        )
        report = row if report is None else report.unionByName(row)
    if raise_on_duplicate:
        bad = [r["checked"] for r in report.filter("not is_unique").collect()]
        if bad:
            raise ValueError(f"not unique: {', '.join(bad)}")
    return report


def temporal_split(articles: DataFrame, cutoff: dt.date = CUTOFF_DATE) -> tuple[DataFrame, DataFrame]:
    """``(old, new)``: strictly before the cut-off date, and the rest."""
    date = F.col("publication_date")
    return articles.filter(date < F.lit(cutoff)), articles.filter(date.isNull() | (date >= F.lit(cutoff)))


def preview_pairs(articles: DataFrame, records: DataFrame, n: int = 10, width: int = 40) -> DataFrame:
    """Title beside record for the first ``n`` ids."""
    left = articles.select("article_id", F.col("title"))
    return (
        left.join(records.select("article_id", "tokens"), "article_id")
        .orderBy("article_id")
        .limit(n)
        .select(
            "article_id",
            F.substring(F.translate("title", "\n", ""), 1, width).alias("title"),
            F.substring(F.array_join("tokens", " "), 1, width).alias("record"),
        )
    )


def lemmatize_by_table(
    records: DataFrame, lexicon: DataFrame, tokens: str = "tokens", id_col: str = "article_id"
) -> DataFrame:
    """Tokens reduced by a table ``form, lemma`` of any size; forms it lacks by the suffix rules.

    Each different word of a row is joined once, with its positions, and the lemmas are
    put back by position. Whether the lexicon is broadcast is left to its measured size;
    a frequent word is split like any skewed join key. Of a form that is listed twice the
    smallest lemma counts. Ids must be unique.
    """
    words = positions_in_rows(records.select(id_col, tokens), tokens, "_words")
    each = exploded(words, [id_col], "_words", "_w").select(id_col, F.col("_w.value").alias("form"), "_w.at")
    forms = lexicon.groupBy("form").agg(F.min("lemma").alias("lemma"))
    lemma = F.coalesce("lemma", suffix_rules(F.col("form")))
    found = each.join(forms, "form", "left").select(id_col, "at", lemma.alias("_lemma"))
    # As many entries as the row has tokens.
    placed = found.select(
        id_col, F.transform("at", lambda p: F.struct(p.alias("p"), F.col("_lemma").alias("t"))).alias("_parts")
    )
    back = placed.groupBy(id_col).agg(F.sort_array(F.flatten(F.collect_list("_parts"))).alias("_parts"))
    lemmas_of = F.transform(F.coalesce("_parts", F.array()), lambda x: x["t"])
    return records.drop(tokens).join(back, id_col, "left").withColumn(tokens, lemmas_of).drop("_parts")


def build_records(
    articles: DataFrame,
    keep: Sequence[str | Column] = (),
    tagger: Callable[[pd.Series], pd.Series] | None = None,
    lexicon: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``article_id, tokens``: prefixed title lemmas, then abstract lemmas.

    ``tagger`` replaces the built-in token filter and lemmatiser: it gets a batch of
    texts and returns the kept lemmas of each, for users with a tagging model. ``lexicon``
    replaces the built-in table of irregular forms, see ``lemmatize_by_table``. ``parts``
    spreads the texts over so many tasks first, for input that lies in few files, see ``spread``.
    """
    articles = spread(articles, parts, "article_id")
    if lexicon is not None:
        title, abstract = (filter_tokens(tokenize(F.col(c))) for c in ("title", "abstract"))
        plain = articles.select("article_id", *keep, title.alias("_title"), abstract.alias("_abstract"))
        plain = plain.withColumn("tokens", F.concat("_title", "_abstract")).withColumn("_n", F.size("_title"))
        found = lemmatize_by_table(plain.drop("_title", "_abstract"), lexicon)
        tokens = F.transform("tokens", lambda t, i: F.when(i < F.col("_n"), F.concat(F.lit(TITLE_PREFIX), t)).otherwise(t))
        return found.withColumn("tokens", tokens).drop("_n")
    base = F.pandas_udf(tagger, "array<string>") if tagger else lemmas
    tokens = F.concat(prefix_title(base(F.col("title"))), base(F.col("abstract")))
    return articles.select("article_id", *keep, tokens.alias("tokens"))
