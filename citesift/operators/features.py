"""The feature families and their combination.

A fitted family holds only parameters of bounded size (term lists, document
frequencies, a topic model) and adds one ``array<double>`` column to the records.
All families read the same row, so combining them needs no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.functions.arrays import counted_in_rows, exploded
from citesift.functions.text import TITLE_PREFIX, add_bigrams, lemmas, prefix_title
from citesift.operators.retrieval import Query

# The three publication types that are features.
PUBLICATION_TYPES = ("Case Report", "Clinical Trial", "Revie")


# --- search terms ---------------------------------------------------------------


def search_term_vocab(spark, queries: Sequence[Query]) -> DataFrame:
    """Distinct base forms of the query texts and their title variants, sorted."""
    text = " ".join(q.text() for q in queries)
    words = spark.range(1).select(lemmas(F.lit(text)).alias("w"))
    both = F.array_distinct(F.concat("w", prefix_title(F.col("w"))))
    return words.select(F.explode(F.array_sort(both)).alias("term"))


def feature_name(term: Column) -> Column:
    """``x_in_title`` for prefixed terms, ``x_in_abstract`` for the others."""
    return F.when(
        term.startswith(TITLE_PREFIX),
        F.concat(F.substring(term, F.lit(len(TITLE_PREFIX) + 1), F.length(term)), F.lit("_in_title")),
    ).otherwise(F.concat(term, F.lit("_in_abstract")))


@dataclass
class SearchTerms:
    """1 for every vocabulary term among the tokens of the record."""

    vocab: list[str]
    names: list[str]
    column: str = "search_terms"

    @classmethod
    def fit(cls, spark, queries: Sequence[Query]) -> SearchTerms:
        # As many rows as the queries have words.
        rows = search_term_vocab(spark, queries).select("term", feature_name(F.col("term")).alias("name")).collect()
        return cls([r["term"] for r in rows], [r["name"] for r in rows])

    def transform(self, records: DataFrame) -> DataFrame:
        flags = [F.array_contains("tokens", F.lit(t)).cast("double") for t in self.vocab]
        return records.withColumn(self.column, F.array(*flags))


# --- publication types ----------------------------------------------------------


@dataclass
class PublicationTypes:
    """1 for every pattern that is a substring of the publication types."""

    patterns: Sequence[str] = PUBLICATION_TYPES
    column: str = "type_flags"

    @property
    def names(self) -> list[str]:
        return [p.lower().replace(" ", "_") for p in self.patterns]

    def transform(self, records: DataFrame) -> DataFrame:
        text = F.coalesce("publication_types", F.lit(""))
        return records.withColumn(self.column, F.array(*[text.contains(p).cast("double") for p in self.patterns]))


# --- TF-IDF bigrams -------------------------------------------------------------


def bigram_counts(records: DataFrame) -> DataFrame:
    """``article_id, bigram, n``, counted within each row."""
    counted = counted_in_rows(add_bigrams(records, "_bigrams"), "_bigrams", "_counts")
    return exploded(counted, ["article_id"], "_counts", "_c").select("article_id", F.col("_c.value").alias("bigram"), "_c.n")


def term_frequencies(docs: DataFrame, terms: str) -> DataFrame:
    """``term, df, tf`` over all documents, from their arrays of terms.

    A document gives one row for each of its different terms, so one shuffle keyed by
    term alone is enough, with map-side sums.
    """
    counted = counted_in_rows(docs.select(terms), terms, "_counts")
    return (
        exploded(counted, [], "_counts", "_c")
        .groupBy(F.col("_c.value").alias("term"))
        .agg(F.count("*").alias("df"), F.sum("_c.n").alias("tf"))
    )


def tfidf_vocab(
    records: DataFrame,
    n_docs: int,
    max_features: int = 50,
    min_df: float = 0.01,
    max_df: float = 0.5,
) -> DataFrame:
    """``term, df, tf`` of the most frequent bigrams inside the document-frequency band."""
    counted = term_frequencies(add_bigrams(records, "_bigrams"), "_bigrams")
    inside = (F.col("df") >= min_df * n_docs) & (F.col("df") <= max_df * n_docs)
    return counted.filter(inside).orderBy(F.col("tf").desc(), "term").limit(max_features)


@dataclass
class BigramTfidf:
    """Sublinear tf times smoothed idf, scaled to unit length per document."""

    vocab: list[str]
    doc_freq: list[int]
    n_docs: int
    column: str = "tfidf"

    @classmethod
    def fit(cls, records: DataFrame, max_features: int = 50, min_df: float = 0.01, max_df: float = 0.5) -> BigramTfidf:
        n_docs = records.count()
        # At most max_features rows, in term order like the columns they become.
        rows = tfidf_vocab(records, n_docs, max_features, min_df, max_df).orderBy("term").collect()
        return cls([r["term"] for r in rows], [r["df"] for r in rows], n_docs)

    @property
    def names(self) -> list[str]:
        return ["tf-idf_" + t.replace(" ", "_") for t in self.vocab]

    def transform(self, records: DataFrame) -> DataFrame:
        if not self.vocab:
            return records.withColumn(self.column, F.array().cast("array<double>"))
        counter = CountVectorizerModel.from_vocabulary(self.vocab, inputCol="_bigrams", outputCol="_counts")
        paired = add_bigrams(records, "_all")
        known = F.filter("_all", lambda b: b.isin(self.vocab))
        counted = counter.transform(paired.withColumn("_bigrams", known).drop("_all"))
        smoothed = [F.log(F.lit((1 + self.n_docs) / (1 + df))) + 1 for df in self.doc_freq]
        weighted = F.zip_with(
            vector_to_array("_counts"),
            F.array(*smoothed),
            lambda tf, idf: F.when(tf > 0, (1 + F.log(tf)) * idf).otherwise(0.0),
        )
        unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit")
        scaled = unit.transform(counted.withColumn("_weighted", array_to_vector(weighted)))
        return scaled.withColumn(self.column, vector_to_array("_unit")).drop(
            "_bigrams", "_counts", "_weighted", "_unit"
        )


# --- dictionary and bag of words ------------------------------------------------


def lda_dictionary(
    records: DataFrame, n_docs: int, no_below: int = 20, no_above: float = 0.4, keep_n: int = 100_000
) -> DataFrame:
    """``term, df`` inside the document-frequency band, at most ``keep_n`` by df."""
    df = (
        records.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    inside = (F.col("df") >= no_below) & (F.col("df") <= int(no_above * n_docs))
    return df.filter(inside).orderBy(F.col("df").desc(), "term").limit(keep_n)


def bag_of_words(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``article_id, term, n`` for the terms of the dictionary.

    Counted within each row. The dictionary is capped at ``keep_n`` terms, so it is
    broadcast, and nothing of the documents is shuffled.
    """
    counted = counted_in_rows(records.select("article_id", "tokens"), "tokens", "_counts")
    return (
        exploded(counted, ["article_id"], "_counts", "_c")
        .select("article_id", F.col("_c.value").alias("term"), "_c.n")
        .join(F.broadcast(dictionary.select("term")), "term")
        .select("article_id", "term", "n")
    )


# --- combination and scaling ----------------------------------------------------


def combine(frames: Sequence[DataFrame], id_col: str = "article_id") -> DataFrame:
    """Join separately made feature frames on the id of the first; missing is 0."""
    joined = reduce(lambda left, right: left.join(right, id_col, "left"), frames)
    return joined.na.fill(0.0, [c for c in joined.columns if c != id_col])


@dataclass
class Standardizer:
    """Mean 0 and variance 1 by the statistics of the training rows.

    Population deviation; a constant column is centred only.
    """

    mean: list[float]
    scale: list[float]

    @classmethod
    def fit(cls, train: DataFrame, column: str = "features") -> Standardizer:
        metrics = Summarizer.metrics("mean", "variance", "count")
        row = (
            train.select(array_to_vector(column).alias("_v"))
            .agg(metrics.summary(F.col("_v")).alias("s"))
            .select("s.*")
            .first()
        )
        n = row["count"]
        # The summary divides by n - 1.
        deviation = [(max(v, 0.0) * (n - 1) / n) ** 0.5 for v in row["variance"].toArray()]
        return cls([float(m) for m in row["mean"].toArray()], [float(d) if d > 1e-12 else 1.0 for d in deviation])

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        # Plain literals: the arrays are as wide as the feature vector.
        stats = F.arrays_zip(
            F.lit(self.mean).cast("array<double>").alias("m"), F.lit(self.scale).cast("array<double>").alias("s")
        )
        return df.withColumn(
            column, F.zip_with(F.col(column), stats, lambda x, p: (x - p["m"]) / p["s"])
        )


def standardize(train: DataFrame, test: DataFrame, column: str = "features") -> tuple[DataFrame, DataFrame]:
    scaler = Standardizer.fit(train, column)
    return scaler.transform(train, column), scaler.transform(test, column)
