"""Topic model on the bag of words, its terms and its coherence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.functions.arrays import exploded, positions_in_rows
from citesift.operators import variational
from citesift.operators.features import lda_dictionary
from citesift.operators.ordering import attach
from citesift.session import durable


@dataclass
class Topics:
    """Topic weights per document from an online variational topic model."""

    vocab: list[str]
    model: variational.TopicModel | None
    n_topics: int
    column: str = "topic_weights"

    @classmethod
    def fit(
        cls,
        records: DataFrame,
        n_topics: int = 50,
        alpha: float = 10.0,
        max_iter: int = 20,
        seed: int = 42,
        no_below: int = 20,
        no_above: float = 0.4,
        keep_n: int = 100_000,
        passes: float = 10.0,
        topic_concentration: float | None = None,
    ) -> Topics:
        """``alpha`` is the prior mass over all topics, ``alpha / n_topics`` each, and stays so.

        Documents are drawn with replacement, ``passes`` times the corpus in all (one
        corpus per iteration at most). The share never drawn is exp(-passes): fewer
        than one in 20,000 after ten passes. ``keep_n`` limits the dictionary's terms.
        """
        n_docs = records.count()
        # At most keep_n terms: the model itself holds n_topics numbers for each.
        rows = lda_dictionary(records, n_docs, no_below, no_above, keep_n).collect()
        topics = cls([r["term"] for r in rows], None, n_topics)
        if topics.vocab:
            topics.model = variational.fit(
                records,
                topics.vocab,
                n_docs,
                n_topics,
                alpha / n_topics,
                1.0 / n_topics if topic_concentration is None else topic_concentration,
                max_iter,
                min(1.0, passes / max_iter),
                seed,
            )
        return topics

    @property
    def names(self) -> list[str]:
        return [f"lda_{i}" for i in range(self.n_topics)]

    def transform(self, records: DataFrame) -> DataFrame:
        """A document without any known token gets the prior, equal weights."""
        prior = F.array(*[F.lit(1.0 / self.n_topics)] * self.n_topics)
        if self.model is None:
            return records.withColumn(self.column, prior)
        # Where no token is known, all topics keep the same mass.
        return records.withColumn(self.column, self.model.shares(records.sparkSession, F.col("tokens"), self.vocab))

    def terms(self, spark, n: int = 10) -> DataFrame:
        """``topic, rank, term, weight``: the top ``n`` words of every topic."""
        if self.model is None:
            return spark.createDataFrame([], "topic int, rank int, term string, weight double")
        # n rows per topic.
        rows = [(topic, rank, self.vocab[term], weight) for topic, rank, term, weight in self.model.describe(n)]
        return spark.createDataFrame(rows, "topic int, rank int, term string, weight double")


# In the sums, stands for all windows instead of those of a topic.
_ALL = -1


def window_counts(records: DataFrame, topic_terms: DataFrame, window: int = 110) -> tuple[DataFrame, DataFrame]:
    """Sliding-window occurrence of the topic words: ``(pairs, total)``.

    ``pairs`` has ``topic, term_a, term_b, windows``, the windows that hold both
    words (one word for ``term_a = term_b``); ``total`` counts all windows of the
    documents with any topic word. A text shorter than the window is one window.

    Windows are never listed. The windows that hold a word at position ``p`` are an
    interval, so the windows holding a word, or either of two, are the length of a
    union of intervals, read off the gaps between sorted positions; those holding
    both follow by inclusion and exclusion. All of that happens within a document's
    row, on the positions of its topic words; only ``(topic, term_a, term_b, windows)``
    is shuffled, with map-side sums.
    """
    # Topics times top words, a few thousand rows at most by its definition.
    topics: dict[str, list[int]] = {}
    for r in topic_terms.select("topic", "term").distinct().collect():
        topics.setdefault(r["term"], []).append(r["topic"])
    schema = "topic int, term_a string, term_b string, windows long"
    if not topics:
        spark = records.sparkSession
        return spark.createDataFrame([], schema), spark.createDataFrame([(0,)], "n_windows long")
    last = F.greatest(F.size("tokens") - window, F.lit(0)).alias("_last")
    placed = positions_in_rows(records.select("tokens", last), "tokens", "_words", lambda t: t.isin(list(topics)))
    # Looked up once for each different word of a document.
    table = F.create_map(*[F.lit(x) for term, numbers in topics.items() for x in (term, sorted(numbers))])
    words = placed.select(
        "_last",
        F.transform(
            "_words",
            lambda w: F.struct(
                w["value"].alias("term"),
                w["at"].alias("at"),
                F.element_at(table, w["value"]).alias("topics"),
                _covered(w["at"], F.col("_last"), window).alias("n"),
            ),
        ).alias("_words"),
    )
    by_topic = words.select(
        "_last",
        "_words",
        F.transform(
            F.array_distinct(F.flatten(F.transform("_words", lambda w: w["topics"]))),
            lambda t: F.struct(
                t.alias("topic"), F.filter("_words", lambda w: F.array_contains(w["topics"], t)).alias("words")
            ),
        ).alias("_topics"),
    )

    def pairs_of(topic: Column) -> Column:
        return F.flatten(
            F.transform(
                topic["words"],
                lambda a, i: F.transform(
                    F.slice(topic["words"], i + 1, F.size(topic["words"])),
                    lambda b: F.struct(
                        topic["topic"].cast("int").alias("topic"),
                        a["term"].alias("term_a"),
                        b["term"].alias("term_b"),
                        F.when(a["term"] == b["term"], a["n"])
                        .otherwise(a["n"] + b["n"] - _covered(F.sort_array(F.concat(a["at"], b["at"])), F.col("_last"), window))
                        .alias("windows"),
                    ),
                ),
            )
        )

    every = F.struct(
        F.lit(_ALL).alias("topic"), F.lit("").alias("term_a"), F.lit("").alias("term_b"), (F.col("_last") + 1).cast("long").alias("windows")
    )
    found = by_topic.select(
        F.concat(
            F.flatten(F.transform("_topics", pairs_of)),
            F.when(F.size("_words") > 0, F.array(every)).otherwise(F.array()),
        ).alias("_pairs")
    )
    # As many rows as topics have pairs of words, read for both results.
    sums = durable(
        exploded(found, [], "_pairs", "_p")
        .select("_p.*")
        .groupBy("topic", "term_a", "term_b")
        .agg(F.sum("windows").alias("windows")),
        "windows",
    )
    total = sums.filter(F.col("topic") == _ALL).agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n_windows"))
    return sums.filter(F.col("topic") != _ALL), total


def _covered(positions: Column, last: Column, window: int) -> Column:
    """Number of start positions in ``0..last`` at most ``window - 1`` before a position; positions rise."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("next"))

    def step(acc: Column, p: Column) -> Column:
        low = F.greatest(p - (window - 1), acc["next"])
        high = F.least(p, last)
        return F.struct(
            (acc["n"] + F.greatest(high - low + 1, F.lit(0))).cast("long").alias("n"),
            F.greatest(acc["next"], high + 1).cast("long").alias("next"),
        )

    return F.aggregate(positions, state, step, lambda acc: acc["n"])


def topic_coherence(records: DataFrame, topic_terms: DataFrame, window: int = 110) -> DataFrame:
    """``topic, coherence``: normalised pointwise mutual information vectors of the
    words against the vector of their topic, by cosine, averaged over the words."""
    eps = 1e-12
    pairs, total = window_counts(records, topic_terms, window)
    single = pairs.filter("term_a = term_b").select("topic", F.col("term_a").alias("term"), F.col("windows").alias("w"))
    words = topic_terms.select("topic", "term").distinct().join(single, ["topic", "term"], "left").na.fill(0, ["w"])
    mirrored = pairs.unionByName(
        pairs.filter("term_a <> term_b").select(
            "topic", F.col("term_b").alias("term_a"), F.col("term_a").alias("term_b"), "windows"
        )
    )
    # From here on: one row per topic and word pair, whatever the corpus size.
    grid = (
        words.select("topic", F.col("term").alias("term_a"), F.col("w").alias("w_a"))
        .join(words.select("topic", F.col("term").alias("term_b"), F.col("w").alias("w_b")), "topic")
        .join(mirrored, ["topic", "term_a", "term_b"], "left")
    )
    grid = attach(grid, total, ())
    n = F.col("n_windows")
    joint = F.coalesce("windows", F.lit(0)) / n
    # A word that never occurs has no information about any other.
    npmi = F.when((F.col("w_a") == 0) | (F.col("w_b") == 0), F.lit(0.0)).otherwise(
        F.log((joint + eps) / ((F.col("w_a") / n) * (F.col("w_b") / n))) / -F.log(joint + eps)
    )
    cells = grid.select("topic", "term_a", "term_b", npmi.alias("x"))
    cells = cells.withColumn("t", F.sum("x").over(Window.partitionBy("topic", "term_b")))
    cosine = F.coalesce(
        F.try_divide(F.sum(F.col("x") * F.col("t")), F.sqrt(F.sum(F.col("x") ** 2)) * F.sqrt(F.sum(F.col("t") ** 2))),
        F.lit(0.0),
    )
    return (
        cells.groupBy("topic", "term_a").agg(cosine.alias("_c")).groupBy("topic").agg(F.avg("_c").alias("coherence"))
    )
