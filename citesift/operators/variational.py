"""Online variational inference of topics, a pass of all drawn documents at a time.

A pass draws documents with replacement, infers the topic mass of each from a random
start, and sums by term and topic what they say about the topics. The sums are added
by blocks of terms; the driver blends them into the topics, which are ``keep_n`` terms
times ``n_topics`` numbers whatever the rows.

The inference repeats the usual update of a document's mass until a plain step moves it
by ``TOLERANCE`` or less on average. Between two plain steps it extrapolates along them
(squared extrapolation), since plain steps alone need hundreds while topics are still
alike. Documents that are not done after some steps go on together, so the matrices stay
wide although a few documents take long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.session import durable

# Of the mean change of a document's mass, in words.
TOLERANCE = 1e-3
# Shape of the random starts, whose mean is 1.
SHAPE = 100.0
# Weight of the n-th pass: (OFFSET + n) ** -DECAY.
OFFSET, DECAY = 1024.0, 0.51
# Terms of documents that are worked on at once, and those whose sums are added at once.
CELLS, TERMS = 8192, 4096
# Documents whose words are numbered at once.
ROWS = 1024
# Steps of the first round, of the longest, and those after which no step is extrapolated any more.
FIRST_STEPS, MOST_STEPS, EXTRAPOLATED = 16, 128, 600
# No extrapolation is longer than so many plain steps.
FARTHEST = 1000.0
# The matrices are cut down to the documents still open when these are fewer than so many.
OPEN_SHARE = 0.75


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """``exp(digamma(x))`` to nine digits for positive ``x``: six steps of the recurrence, then the series at ``x + 6``."""
    y = x * (x + 5)
    steps = (2 * x + 5) * (y * (3 * y + 20) + 24) / (y * (y + 4) * (y + 6))
    w = x + 5.5
    q = 1 / (w * w)
    return np.exp(-steps) * w * (1 + q * (1 / 24 - q * (37 / 5760 - q * (10313 / 2903040))))


@dataclass
class Bags:
    """Documents as counted terms: those of document ``i`` lie from ``ends[i]`` to ``ends[i + 1]``."""

    ends: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    @classmethod
    def of(cls, tokens: pa.Array, vocab: pa.Array) -> Bags:
        sizes, terms, counts = [np.zeros(1, np.int64)], [], []
        # A few documents at a time, since numbering their words takes several times their memory.
        for at in range(0, len(tokens), ROWS):
            part = tokens.slice(at, ROWS)
            found = pc.index_in(part.flatten(), value_set=vocab)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            rows = pc.list_parent_indices(part).to_numpy(zero_copy_only=False)[known]
            keys = rows.astype(np.int64) * len(vocab) + found.drop_null().to_numpy()
            different, times = np.unique(keys, return_counts=True)
            row, term = np.divmod(different, len(vocab))
            sizes.append(np.bincount(row, minlength=len(part)))
            terms.append(term.astype(np.int32))
            counts.append(times.astype(np.int32))
        none = np.zeros(0, np.int32)
        return cls(np.cumsum(np.concatenate(sizes)), np.concatenate([none, *terms]), np.concatenate([none, *counts]))


def infer(bags: Bags, wanted: np.ndarray, start: np.ndarray, topics: np.ndarray, alpha: float) -> np.ndarray:
    """Topic mass of the ``wanted`` documents from ``start``, a row each; ``alpha`` each where no term is known.

    ``topics (term, topic)`` is exp of the expected log weight.
    """
    sizes = np.diff(bags.ends)[wanted]
    mass = np.where(sizes[:, None] > 0, start, alpha)
    todo = np.flatnonzero(sizes)
    taken, steps = 0, FIRST_STEPS
    while len(todo):
        todo = todo[np.argsort(sizes[todo], kind="stable")]
        left = [_steps(bags, wanted, part, mass, topics, alpha, steps, taken < EXTRAPOLATED) for part in _alike(todo, sizes)]
        todo = np.concatenate(left)
        taken, steps = taken + steps, min(2 * steps, MOST_STEPS)
    return mass


def _alike(rows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of rising size in parts of at most ``CELLS`` cells, or of one row."""
    at = 0
    while at < len(rows):
        # As many as fit at the size of the last one, which is the largest.
        room = np.arange(1, min(len(rows) - at, CELLS) + 1) * sizes[rows[at : at + CELLS]] <= CELLS
        n = max(int(room.sum()), 1)
        yield rows[at : at + n]
        at += n


def _steps(
    bags: Bags, wanted: np.ndarray, rows: np.ndarray, mass: np.ndarray, topics: np.ndarray, alpha: float, steps: int, extrapolate: bool
) -> np.ndarray:
    """Take the mass of ``rows`` so many steps further, in place; the rows not done by then."""
    begin, end = bags.ends[wanted[rows]], bags.ends[wanted[rows] + 1]
    places = begin[:, None] + np.arange((end - begin).max())
    inside = places < end[:, None]
    places = np.where(inside, places, 0)
    x, n = topics[bags.terms[places]], np.where(inside, bags.counts[places], 0).astype(np.float64)
    now, open_ = mass[rows], np.ones(len(rows), bool)

    def step(m: np.ndarray) -> np.ndarray:
        shares = exp_digamma(m)
        total = np.maximum(np.matmul(x, shares[:, :, None])[:, :, 0], 1e-100)
        return alpha + shares * np.matmul((n / total)[:, None, :], x)[:, 0, :]

    for _ in range(0, steps, 2):
        one = step(now)
        two = step(one)
        first, second = one - now, two - one
        done = open_ & (np.abs(second).mean(axis=1) <= TOLERANCE)
        if done.any():
            mass[rows[done]] = two[done]
            open_ &= ~done
            if open_.sum() < OPEN_SHARE * len(rows):
                rows, x, n, now, two, first, second = (a[open_] for a in (rows, x, n, now, two, first, second))
                open_ = np.ones(len(rows), bool)
                if not len(rows):
                    break
        if extrapolate:
            turn = second - first
            far = np.sqrt((first**2).sum(axis=1) / np.maximum((turn**2).sum(axis=1), 1e-300))
            far = np.clip(far, 1.0, FARTHEST)[:, None]
            # A step of length one is the second plain one. No mass is below its prior.
            two = np.maximum(now + 2 * far * first + far**2 * turn, alpha)
        now = two
    mass[rows[open_]] = now[open_]
    return rows[open_]


def _add_sums(sums: np.ndarray, bags: Bags, wanted: np.ndarray, times: np.ndarray, mass: np.ndarray, topics: np.ndarray) -> None:
    """Add how often each term was drawn for each topic, but for the factor ``topics``."""
    shares = exp_digamma(mass)
    for i, m, share in zip(wanted, times, shares):
        place = slice(bags.ends[i], bags.ends[i + 1])
        terms = bags.terms[place]
        total = np.maximum(topics[terms] @ share, 1e-100)
        # The terms of a document are different ones.
        sums[terms] += np.outer(m * bags.counts[place] / total, share)


def _expected(weights: np.ndarray) -> np.ndarray:
    """Exp of the expected log weight of each term in each topic."""
    found = np.empty_like(weights)
    for at in range(0, len(weights), TERMS):
        found[at : at + TERMS] = exp_digamma(weights[at : at + TERMS])
    found /= exp_digamma(weights.sum(axis=0))
    return found


@dataclass
class TopicModel:
    """``weights (term, topic)`` of a fit; ``alpha`` is the prior mass of a topic in a document."""

    weights: np.ndarray
    alpha: float
    seed: int
    _shared: Broadcast | None = field(default=None, repr=False, compare=False)

    def describe(self, n: int) -> Iterator[tuple[int, int, int, float]]:
        """``topic, rank, term, weight`` of the ``n`` heaviest terms of every topic; the weights of all are one together."""
        totals = self.weights.sum(axis=0)
        for topic, column in enumerate(self.weights.T):
            for rank, term in enumerate(np.argsort(-column, kind="stable")[:n].tolist(), 1):
                yield topic, rank, term, float(column[term] / totals[topic])

    def shares(self, spark: SparkSession, tokens: Column, vocab: list[str]) -> Column:
        """Topic weights of a document, one together; all documents start alike, so equal ones get equal weights."""
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast(_expected(self.weights))
        shared, alpha = self._shared, self.alpha
        start = np.random.default_rng(self.seed).gamma(SHAPE, 1 / SHAPE, self.weights.shape[1])

        @F.arrow_udf("array<double>")
        def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            terms = pa.array(vocab)
            for batch in batches:
                bags = Bags.of(batch, terms)
                mass = infer(bags, np.arange(len(bags)), np.tile(start, (len(bags), 1)), shared.value, alpha)
                mass /= mass.sum(axis=1, keepdims=True)
                ends = np.arange(len(mass) + 1, dtype=np.int32) * mass.shape[1]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(mass.ravel()))

        return weigh(tokens)


def fit(
    records: DataFrame, vocab: list[str], n_docs: int, n_topics: int, alpha: float, eta: float, passes: int, rate: float, seed: int
) -> TopicModel:
    """Topics after so many ``passes``, each of ``rate`` times the ``n_docs`` documents, drawn with replacement.

    ``alpha`` and ``eta`` are the prior mass of a topic in a document and of a term in a
    topic. A document drawn several times in a pass is inferred once and counts so often.
    """
    context = records.sparkSession.sparkContext

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocab)
        for batch in batches:
            bags = Bags.of(batch.column(0), known)
            parts = [a.tobytes() for a in (bags.ends.astype(np.int64), bags.terms, bags.counts)]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["ends", "terms", "counts"])

    table = durable(records.select("tokens").mapInArrow(pack, "ends binary, terms binary, counts binary"), "bags")
    # A part has sums for all terms, so there are no more parts than cores.
    bags = table.rdd.map(tuple).coalesce(context.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    weights = np.random.default_rng(seed).gamma(SHAPE, 1 / SHAPE, (len(vocab), n_topics))
    try:
        iteration = 0
        for number in range(passes):
            iteration += _pass(bags, weights, n_docs, alpha, eta, rate, [seed, number], (OFFSET + iteration + 1) ** -DECAY)
    finally:
        bags.unpersist()
    return TopicModel(weights, alpha, seed)


def _pass(
    bags: RDD, weights: np.ndarray, n_docs: int, alpha: float, eta: float, rate: float, seed: list[int], blend: float
) -> bool:
    """Blend what drawn documents say into ``weights``, in place; False if none was drawn that says anything."""
    n_topics = weights.shape[1]
    topics = _expected(weights)
    shared = bags.context.broadcast(topics)

    def sums_of(part: int, rows: Iterable[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        rng = np.random.default_rng([*seed, part])
        topics, sums = shared.value, None
        for body in rows:
            here = Bags(*(np.frombuffer(b, t) for b, t in zip(body, (np.int64, np.int32, np.int32))))
            drawn = rng.poisson(rate, len(here))
            wanted = np.flatnonzero(drawn)
            start = rng.gamma(SHAPE, 1 / SHAPE, (len(wanted), n_topics))
            mass = infer(here, wanted, start, topics, alpha)
            sums = np.zeros_like(topics) if sums is None else sums
            _add_sums(sums, here, wanted, drawn[wanted], mass, topics)
        for at in range(0, 0 if sums is None else len(sums), TERMS):
            yield at, sums[at : at + TERMS]

    added = bags.mapPartitionsWithIndex(sums_of).reduceByKey(np.add)
    # So many are drawn on average.
    scale = n_docs / np.ceil(rate * n_docs)
    learnt = False
    # One block for every few thousand terms of the dictionary, a part of them at a time.
    for at, block in added.toLocalIterator():
        place = slice(at, at + TERMS)
        if not learnt and block.any():
            learnt = True
            weights *= 1 - blend
            weights += blend * eta
        block *= topics[place]
        weights[place] += blend * scale * block
    # Else the shuffle files of all passes stay until the driver collects its garbage.
    added._jrdd.rdd().cleanShuffleDependencies(True)
    shared.destroy()
    return learnt
