"""Boolean retrieval over a corpus and the merging of query results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.functions.text import padded_text, tokenize
from citesift.operators.ordering import global_rank


@dataclass(frozen=True)
class Query:
    """A named boolean query: every group must match, a group by any of its terms.

    A term is a word, a phrase, or either with a trailing ``*``; case is ignored.
    """

    name: str
    groups: tuple[tuple[str, ...], ...]

    def matches(self, padded: Column) -> Column:
        return reduce(
            Column.__and__,
            [reduce(Column.__or__, [_term_matches(padded, t) for t in group]) for group in self.groups],
        )

    def text(self) -> str:
        return " ".join(term for group in self.groups for term in group)


def _term_matches(padded: Column, term: str) -> Column:
    words = " ".join(term.lower().rstrip("*").split())
    closing = "" if term.endswith("*") else " "
    return padded.contains(f" {words}{closing}")


def retrieve(
    docs: DataFrame,
    queries: Sequence[Query],
    text: str = "text",
    id_col: str = "doc_id",
    max_results: int | None = None,
) -> DataFrame:
    """``(search_term, term_idx, <id_col>)`` for every document and query that match.

    One scan of the text: all queries are tested on the row and the matching ones
    exploded. ``max_results``, where a user asks for it, keeps the lowest ids of each
    query by a distributed rank, so a frequent query is not sorted by one task.
    """
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    q.matches(F.col("_padded")),
                    F.struct(F.lit(q.name).alias("search_term"), F.lit(i).alias("term_idx")),
                )
                for i, q in enumerate(queries)
            ]
        )
    )
    matched = (
        docs.select(F.col(id_col), padded_text(tokenize(F.col(text))).alias("_padded"))
        .select(id_col, F.explode(hits).alias("_hit"))
        .select("_hit.search_term", "_hit.term_idx", id_col)
    )
    if max_results is None:
        return matched
    ranked = global_rank(matched, [F.col(id_col).asc()], ["term_idx"], "_rank")
    return ranked.filter(F.col("_rank") <= max_results).select("search_term", "term_idx", id_col)


def extract_id_date(retrieved: DataFrame) -> DataFrame:
    """First line of ``pubmed_id``; the last record (``ord``) of an id in a query wins."""
    return (
        retrieved.withColumn("pubmed_id", F.split_part("pubmed_id", F.lit("\n"), F.lit(1)))
        .filter(F.col("pubmed_id") != "")
        .groupBy("search_term", "term_idx", "pubmed_id")
        .agg(
            F.max_by(F.coalesce("publication_date", F.lit("")), "ord").alias("publication_date"),
            F.min("ord").alias("ord"),
        )
    )


def merge_queries(extracted: DataFrame, with_order: bool = False) -> DataFrame:
    """One row per id; the date of the latest query that found it wins.

    ``with_order`` adds ``found``, the place of its first find: query, then position.
    """
    found = [F.min(F.struct("term_idx", "ord")).alias("found")] if with_order else []
    return extracted.groupBy("pubmed_id").agg(
        F.max_by("publication_date", "term_idx").alias("publication_date"), *found
    )


def retrieval_counts(extracted: DataFrame) -> DataFrame:
    """Documents per query, and the number of distinct documents as term -1.

    A document shows up at most once per query, so the per-query figure is a
    plain count; only the total needs distinct ids.
    """
    per_term = extracted.groupBy("search_term", "term_idx").agg(F.count("*").alias("articles"))
    total = extracted.select("pubmed_id").distinct().agg(F.count("*").alias("articles")).select(
        F.lit("unique").alias("search_term"), F.lit(-1).alias("term_idx"), "articles"
    )
    return per_term.unionByName(total)


def retrieval_ends(extracted: DataFrame, n: int = 3) -> DataFrame:
    """The first and last ``n`` merged documents in the order they were first found."""
    merged = extracted.groupBy("pubmed_id").agg(
        F.max_by("publication_date", "term_idx").alias("publication_date"),
        F.min(F.struct("term_idx", "ord")).alias("found"),
    )
    merged = merged.select("pubmed_id", "publication_date", "found.term_idx", "found.ord")
    first = merged.orderBy("term_idx", "ord").limit(n).withColumn("part", F.lit("first"))
    last = merged.orderBy(F.desc("term_idx"), F.desc("ord")).limit(n).withColumn("part", F.lit("last"))
    return first.unionByName(last)
