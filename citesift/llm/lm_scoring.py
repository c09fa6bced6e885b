"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

The model predicts one of ``CLASSES`` classes (the most frequent training words, the
end of a text, and all other words as one) from the two before it: the context
vectors are weighted per position and summed, and multiplied with each class's
vector. The class of other words is cut further down to single words, each with a vector
of its own (``lm_words``), and one unseen word has its smoothed share there, so that the
probabilities of all words sum to one, as those of the unigram base do. In the context,
other words are known as one class.

What is learned covers the whole training part: word counts, and counts of class
triples. Triples are counted in ``SHARDS`` shards of the documents; each shard is a
sample of the same corpus, no larger than CLASSES**3 rows, and is trained on by one
task, in ``PASSES`` passes over all its triples, each weighing as often as it was counted;
the tasks' weights are averaged, ``ROUNDS`` times. Nothing is drawn: the noise enters by
its expectation over the classes. All training is numpy inside tasks.

Scoring multiplies all contexts with all classes in batches and normalises them
once per worker. Counts and vectors of the ``FREQUENT`` most frequent words are broadcast;
the other words of a document go to theirs by shuffle, with their contexts. Words are known
by a 64-bit hash.

Null and empty texts have one token, the end. A null id belongs to the training
part. With nothing to learn from, every token has the base's probability. Repeated
rows are counted again and score alike; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm import lm_words
from citesift.llm.common import ROW_KEY, keyed
from citesift.session import durable

CLASSES = 160
WIDTH = 24
FREQUENT = 1 << 18
SHARDS = 8
ROUNDS = 2
# Passes over all triples in a round, and steps of a pass.
PASSES = 12
STEPS = 100
# Noise words for each word.
NOISE = 32
RATE = 0.08
SEED = 11
WORD_CACHE = 1 << 18
# Tokens handled at once.
BLOCK = 500_000
OTHER, END = 0, 1
END_HASH = int(np.array([xxhash.xxh3_64_intdigest(b"")], np.uint64).view(np.int64)[0])


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words and of the end of a text."""
    # bytes.lower() and bytes.split() know ASCII only, as the word pattern does.
    words = (text or "").encode().lower().split()
    words.append(b"")
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)).view(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id is not."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(7)) == 2


def _blocks(batches: Iterator[pa.RecordBatch], at: int):
    """Token hashes of some rows, flat, with their lengths and the batch's rows they come from."""
    for batch in batches:
        texts, start, total, found = batch.column(at), 0, 0, []
        for k in range(len(batch)):
            found.append(token_hashes(texts[k].as_py()))
            total += len(found[-1])
            if total >= BLOCK or k == len(batch) - 1:
                yield batch, start, np.array([len(f) for f in found]), np.concatenate(found)
                start, total, found = k + 1, 0, []


def word_counts(texts: DataFrame) -> DataFrame:
    """``h, c`` over ``texts (text)``; words are counted per block before they are shuffled."""

    def run(batches):
        for _, _, _, tokens in _blocks(batches, 0):
            h, c = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "c"])

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Lookup:
    """Values of a bounded set of hashes; all others get the default."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def __call__(self, wanted: np.ndarray, default: int) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(wanted), default, np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], default)


def _contexts(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of the two classes before each token; CLASSES stands for what is before a text."""
    starts = np.cumsum(lengths) - lengths
    last = np.empty_like(classes)
    last[1:] = classes[:-1]
    last[starts] = CLASSES
    before = np.empty_like(last)
    before[1:] = last[:-1]
    before[starts] = CLASSES
    return before * (CLASSES + 1) + last


def triple_counts(texts: DataFrame, classes: Lookup) -> DataFrame:
    """``shard, triple, n`` over ``texts (shard, text)``."""
    shared = texts.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        for batch, start, lengths, tokens in _blocks(batches, 1):
            own = shared.value(tokens, OTHER)
            shards = batch.column(0).slice(start, len(lengths)).to_numpy(zero_copy_only=False)
            triples = _contexts(own, lengths) * CLASSES + own
            both = np.repeat(shards.astype(np.int64), lengths) * (CLASSES + 1) ** 2 * CLASSES + triples
            t, n = np.unique(both, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], names=["t", "n"])

    size = (CLASSES + 1) ** 2 * CLASSES
    counts = texts.mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    return counts.select(
        F.floor(F.col("t") / size).cast("int").alias("shard"), F.pmod(F.col("t"), F.lit(size)).alias("triple"), "n"
    )


@dataclass
class Known:
    """Count, class and rank among the other words of each broadcast word, and of any other word in the last place."""

    place: Lookup
    counts: np.ndarray
    classes: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray, classes: Lookup) -> Known:
        own = np.append(classes(keys, OTHER), OTHER)
        other = own == OTHER
        other[-1] = False
        ranks = np.where(other, np.cumsum(other) - 1, -1)
        return cls(Lookup(keys, np.arange(len(keys))), np.append(values, 0), own, ranks)

    @property
    def others(self) -> int:
        return int(self.ranks.max()) + 1


def other_counts(texts: DataFrame, known: Known, deal: lm_words.Deal) -> DataFrame:
    """Words of the class of others in their contexts over ``texts (text)``, packed, see ``lm_words``."""
    shared = texts.sparkSession.sparkContext.broadcast((known, deal))

    def run(batches):
        known, deal = shared.value
        for _, _, lengths, tokens in _blocks(batches, 0):
            place = known.place(tokens, len(known.counts) - 1)
            own = known.classes[place]
            other = own == OTHER
            rows = lm_words.packed_counts(known.ranks[place[other]], tokens[other], _contexts(own, lengths)[other], deal)
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, lm_words.PACKED.types)], schema=lm_words.PACKED)

    return texts.mapInArrow(run, "shard int, word binary, ctx binary, n binary")


class Model:
    """Context vectors, position weights, class vectors and biases."""

    def __init__(self, noise: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.context = rng.normal(0, 0.1, (CLASSES + 1, WIDTH))
        self.weights = np.ones((2, WIDTH)) * 0.5
        self.target = rng.normal(0, 0.1, (CLASSES, WIDTH))
        self.bias = np.log(noise)
        self.used = CLASSES

    NAMES = ("context", "weights", "target", "bias")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).copy())
            at += old.size
        return self

    def features(self) -> np.ndarray:
        """What is multiplied with a word's vector, a row per context."""
        both = (self.context * self.weights[0])[:, None] + self.context * self.weights[1]
        return both.reshape(-1, WIDTH).astype(np.float32)

    def log_probabilities(self) -> np.ndarray:
        """Normalised log10 probabilities, a row per context, by batched matrix products."""
        first = self.context * self.weights[0]
        last = self.context * self.weights[1]
        out = np.empty(((CLASSES + 1) ** 2, CLASSES), np.float32)
        for a in range(CLASSES + 1):
            scores = (first[a] + last) @ self.target.T + self.bias
            scores[:, self.used :] = -np.inf
            top = scores.max(axis=1, keepdims=True)
            scores -= top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True))
            out[a * (CLASSES + 1) : (a + 1) * (CLASSES + 1)] = scores / np.log(10)
        return out


def train_shard(model: Model, triples: np.ndarray, counts: np.ndarray, noise: np.ndarray, seed: int, rate: float) -> Model:
    """Noise-contrastive estimation with Adagrad, over all triples in each pass.

    A context's triples are taken together. One that holds more than a step's share
    of the counts is dealt evenly over several steps, so that steps weigh alike.
    """
    rng = np.random.default_rng(seed)
    contexts, target = np.divmod(triples, CLASSES)
    seen, row = np.unique(contexts, return_inverse=True)
    # No larger than CLASSES**3 numbers, however many triples were counted.
    table = np.zeros((len(seen), CLASSES), np.float32)
    table[row, target] = counts * (STEPS / counts.sum())
    steps = np.maximum(np.ceil(table.sum(axis=1)), 1).astype(np.int64)
    dealt = np.repeat(np.arange(len(seen)), steps)
    first, last = np.divmod(seen, CLASSES + 1)
    past = {k: np.full_like(getattr(model, k), 1e-4) for k in Model.NAMES}
    log_noise = np.log(NOISE * noise)
    one_hot = np.eye(CLASSES + 1)

    def move(name: str, gradient: np.ndarray) -> None:
        past[name] += gradient**2
        setattr(model, name, getattr(model, name) - rate * gradient / np.sqrt(past[name]))

    for _ in range(PASSES):
        for chosen in np.array_split(rng.permutation(dealt), min(STEPS, len(dealt))):
            a, b = first[chosen], last[chosen]
            found = table[chosen] / steps[chosen, None]
            ra, rb = model.context[a], model.context[b]
            predicted = ra * model.weights[0] + rb * model.weights[1]
            real = 1 / (1 + np.exp(log_noise - model.bias - predicted @ model.target.T))
            # Words are to be told as real, the noise that goes with them as noise.
            d = found * (real - 1) + found.sum(axis=1, keepdims=True) * (NOISE * noise) * real
            d_predicted = d @ model.target
            d_context = one_hot[a].T @ (d_predicted * model.weights[0]) + one_hot[b].T @ (d_predicted * model.weights[1])
            d_weights = np.stack([(d_predicted * ra).sum(axis=0), (d_predicted * rb).sum(axis=0)])
            move("target", d.T @ predicted)
            move("bias", d.sum(axis=0))
            move("context", d_context)
            move("weights", d_weights)
    return model


def _shard_task(start, noise: np.ndarray, turn: int):
    def run(key, group):
        shard = int(key[0])
        model = Model(noise).load(start.value)
        # Rows come in any order; the steps must not depend on it.
        order = np.argsort(group["triple"].to_numpy())
        t, n = group["triple"].to_numpy()[order], group["n"].to_numpy()[order]
        train_shard(model, t, n, noise, SEED + 100 * turn + shard, RATE / (1 + turn))
        return pd.DataFrame({"shard": [shard], "total": [int(n.sum())], "weights": [model.flat()]})

    return run


def fit(triples: DataFrame, used: int) -> Model:
    """Train on ``triples (shard, triple, n)``, a task per shard; weights are averaged after each round.

    ``used`` is the number of classes that stand for something.
    """
    by_class = triples.groupBy(F.pmod("triple", F.lit(CLASSES)).alias("w")).agg(F.sum("n").alias("n")).collect()
    noise = np.ones(CLASSES)
    for r in by_class:
        noise[r["w"]] += r["n"]
    noise = noise / noise.sum()
    weights = Model(noise).flat()
    for k in range(ROUNDS):
        run = _shard_task(triples.sparkSession.sparkContext.broadcast(weights), noise, k)
        # One row of weights per shard.
        found = triples.groupBy("shard").applyInPandas(run, "shard int, total long, weights array<double>").collect()
        if found:
            found.sort(key=lambda r: r["shard"])
            weights = np.average([r["weights"] for r in found], axis=0, weights=[r["total"] for r in found])
    model = Model(noise).load(weights)
    model.used = used
    return model


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row per row of ``docs``."""
    spark = docs.sparkSession
    training = docs.filter(~held_out(F.col("doc_id")))
    counts = durable(word_counts(training.select("text")), "word-counts")
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(sums["n"] or 0), int(sums["v"])
    # FREQUENT rows and the end at most; ties are cut by the hash.
    top = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).unionAll(counts.filter(F.col("h") == END_HASH))
    top = top.distinct().toPandas()
    keys, values = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    order = np.lexsort((keys, -values))
    keys, values = keys[order], values[order]
    named = [int(h) for h in keys if h != END_HASH][: CLASSES - 2]
    classes = Lookup(np.array([END_HASH, *named], np.int64), np.array([END, *range(2, 2 + len(named))], np.int64))
    texts = training.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARDS)).cast("int").alias("shard"), "text")
    model = fit(durable(triple_counts(texts, classes), "triples"), len(classes.keys) + 1) if n else None
    known = Known.of(keys, values, classes)
    # Smoothed counts of all words in the class of others, one unseen word included.
    rest = float(n + v + 1 - (known.counts[known.place(classes.keys, len(keys))] + 1).sum()) if n else 1.0
    deal = lm_words.Deal(known.others, v - len(keys))
    words, beyond = None, None
    if rest > 1:
        counted = other_counts(training.select("text"), known, deal)
        words, beyond = lm_words.fit(counted, deal, model.features(), float(np.log10(1 - 1 / rest)))
    shared = spark.sparkContext.broadcast((known, words, model))

    def run(batches):
        frequent, words, model = shared.value
        table = model.log_probabilities() if model else None
        for batch, start, lengths, tokens in _blocks(batches, 3):
            place = frequent.place(tokens, len(frequent.counts) - 1)
            found, own = frequent.counts[place], frequent.classes[place]
            row = np.repeat(np.arange(len(lengths)), lengths)
            known = found > 0
            logs = np.where(known, np.log10(found + 1.0), 0.0)
            contexts = _contexts(own, lengths)
            by_class = table[contexts, own].astype(np.float64) if table is not None else np.zeros(len(tokens))
            if words is not None:
                other = np.flatnonzero(known & (own == OTHER))
                by_class[other] += words.logs(frequent.ranks[place[other]], contexts[other])
            by_row = lambda x: np.bincount(row, weights=x, minlength=len(lengths))
            rare = np.flatnonzero(~known)
            # Repetitions of a rare word in the same context within a document are counted here.
            order, at = lm_words.runs(row[rare], tokens[rare], contexts[rare])
            times = np.diff(np.append(at, len(order)))
            rare = rare[order[at]]
            cuts = np.searchsorted(row[rare], np.arange(len(lengths) + 1)).astype(np.int32)
            columns = [
                *(batch.column(k).slice(start, len(lengths)) for k in range(3)),
                pa.array(lengths.astype(np.int64)),
                pa.array(by_row(known).astype(np.int64)),
                pa.array(by_row(logs)),
                pa.array(by_row(by_class)),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(tokens[rare])),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(contexts[rare].astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_COLUMNS)

    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = durable(rows.mapInArrow(run, _SCHEMA), "lm-rows")
    if beyond is not None and deal.beyond:
        rare = rows.select(*ROW_KEY, F.explode(F.arrays_zip("rare", "ctx", "times")).alias("r")).select(
            *ROW_KEY, F.col("r.rare").alias("h"), F.col("r.ctx").alias("ctx"), F.col("r.times").alias("times")
        )
        rare = lm_words.beyond_scores(rare, beyond, shared, deal.parts)
    else:
        # All training words are broadcast, so the others are unseen ones.
        rare = spark.createDataFrame([], "_id long, _tk long, rare_known long, rare_logs double, rare_model double")
    # A repeated row has brought its rare words as often as it is repeated.
    copies = rows.groupBy(*ROW_KEY).agg(F.count("*").alias("copies")).filter("copies > 1")
    joined = rows.drop("rare", "ctx", "times").join(rare, ROW_KEY, "left").join(copies, ROW_KEY, "left")
    each = F.coalesce("copies", F.lit(1))
    rare_known = F.coalesce(F.col("rare_known") / each, F.lit(0)).cast("long")
    rare_logs = F.coalesce(F.col("rare_logs") / each, F.lit(0.0))
    base = F.col("logs") + rare_logs - F.col("n_tokens") * float(np.log10(n + v + 1))
    rare_model = F.coalesce(F.col("rare_model") / each, F.lit(0.0))
    unseen = F.col("n_tokens") - F.col("known") - rare_known
    model_score = F.col("model") + rare_model - unseen * float(np.log10(rest)) if n else base
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + rare_known).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        model_score.alias("score"),
    )


_COLUMNS = ["_id", "_tk", "doc_id", "n_tokens", "known", "logs", "model", "rare", "ctx", "times"]
_SCHEMA = (
    "_id long, _tk long, doc_id long, n_tokens long, known long, logs double, model double, "
    "rare array<long>, ctx array<int>, times array<int>"
)
