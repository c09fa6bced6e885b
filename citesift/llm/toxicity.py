"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly.

A word is the bag of its character n-grams (with word ends) and itself, hashed
into ``BUCKETS`` embedding rows; a text is the average of its words. A softmax
over two classes sits on top; embeddings and softmax are trained together with
Adam in numpy. A misspelling that was never seen shares most n-grams, and so its
vector, with the word it stands for. Each different word of a text counts once.

The classifier learns from a bounded sample of labelled rows: at most
``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean ones, those with the smallest digest
of their id, and of these as many as have ``MAX_ENTRIES`` bag entries together, of
six bytes each. That is about 300 MB however long the texts are; texts of the usual
length stay far below, with 6,000 rows and some 90 MB. Of an id with several texts the
one with the smallest digest is taken. Bags are counted in tasks, and one task trains
on those of the sample; one number per bucket and the bias reach the driver. Every whole text is scored, where only one number
per bucket is needed, because averaging and softmax are linear in the embeddings.

Null and empty texts get the score of an empty bag. Labels that are null are not
used; an id labelled twice counts as toxic if one label says so. Without labels
of both kinds every score is 0. Repeated rows score alike; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citesift.llm.common import pieces
from citesift.session import durable

# A bucket's number fits in 16 bits.
BUCKETS = 1 << 16
WIDTH = 12
SHORTEST, LONGEST = 3, 6
MAX_TOXIC, MAX_CLEAN = 1500, 4500
MAX_ENTRIES = 50_000_000
# Updates, whatever the size of the sample.
STEPS = 940
BATCH = 64
RATE = 0.05
DECAY = 1e-5
# Toxic rows are fewer.
TOXIC_WEIGHT = 2.0
SEED = 7
# Factor on averages, which run over hundreds of words.
SCALE = 20.0
THRESHOLD = 0.7
# Shorter texts are averaged as if they had so many different words.
FEWEST = 20
WORD_CACHE = 200_000
# Texts whose new words are hashed together.
TEXTS = 64

# Lower-cases A-Z and blanks what stands between words.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 33 or chr(b) in ".,;:!?()[]{}<>|\"'`" else b for b in range(256)
)


def tokens(text: str | None) -> set[bytes]:
    """The different words of a text: repeating one must not outvote the others."""
    return set((text or "").encode().translate(_TABLE).split())


def word_buckets(word: bytes) -> list[int]:
    """Buckets of the word and of its n-grams, word ends marked."""
    marked = f"<{word.decode('utf-8', 'replace')}>"
    n = len(marked)
    grams = [marked]
    for size in range(SHORTEST, min(LONGEST, n - 1) + 1):
        grams += [marked[i : i + size] for i in range(n - size + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


# The usual table of CRC-32 by byte, so that all n-grams are hashed at once as zlib does it.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def buckets_of(words: Iterable[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words in some order, and for all their buckets the word's place and the bucket; see ``word_buckets``."""
    words = list(words)
    plain = [w for w in words if w.isascii()]
    other = [w for w in words if not w.isascii()]
    owners, buckets = [], []
    if plain:
        marked = [b"<%b>" % w for w in plain]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        owner = np.repeat(np.arange(len(plain)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(owner))
        data = np.frombuffer(b"".join(marked) + bytes(LONGEST), np.uint8)
        state = np.full(len(owner), 0xFFFFFFFF, np.uint32)
        for size in range(1, LONGEST + 1):
            state = _CRC[(state ^ data[size - 1 : size - 1 + len(owner)]) & 255] ^ (state >> np.uint32(8))
            if size >= SHORTEST:
                used = (left >= size) & (sizes[owner] > size)
                owners.append(owner[used])
                buckets.append((state[used] ^ np.uint32(0xFFFFFFFF)) % BUCKETS)
        owners.append(np.arange(len(plain)))
        buckets.append(np.fromiter(map(zlib.crc32, marked), np.uint32, len(marked)) % BUCKETS)
    for k, word in enumerate(other, len(plain)):
        found = word_buckets(word)
        owners.append(np.full(len(found), k))
        buckets.append(np.array(found, np.uint32))
    if not words:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    return plain + other, np.concatenate(owners), np.concatenate(buckets).astype(np.int64)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and their shares in its average."""
    found, owner, buckets = buckets_of(tokens(text))
    if not found:
        return np.zeros(0, np.uint16), np.zeros(0, np.float32)
    weights = np.bincount(buckets, 1 / np.bincount(owner)[owner], BUCKETS)
    used = np.flatnonzero(weights)
    return used.astype(np.uint16), (weights[used] / max(FEWEST, len(found))).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """One number per bucket, and the bias: the difference of the two class scores."""
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), -40.0
    rng = np.random.default_rng(SEED)
    embeddings = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    softmax = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    bias = np.log(np.bincount(labels, minlength=2) / len(labels)).astype(np.float32)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("e", embeddings), ("s", softmax), ("b", bias))}
    step = 0

    def move(name: str, values: np.ndarray, gradient: np.ndarray, rows=slice(None)) -> None:
        first, second = state[name]
        first[rows] = 0.9 * first[rows] + 0.1 * gradient
        second[rows] = 0.99 * second[rows] + 0.01 * gradient**2
        update = (first[rows] / (1 - 0.9**step)) / (np.sqrt(second[rows] / (1 - 0.99**step)) + 1e-8)
        values[rows] -= RATE * update

    while step < STEPS:
        order = rng.permutation(len(bags))
        for i in range(0, min(len(order), BATCH * (STEPS - step)), BATCH):
            chosen = order[i : i + BATCH]
            step += 1
            buckets = np.concatenate([bags[j][0] for j in chosen])
            shares = np.concatenate([bags[j][1] for j in chosen])
            sizes = np.array([len(bags[j][0]) for j in chosen])
            used, place = np.unique(buckets, return_inverse=True)
            dense = np.zeros((len(chosen), len(used)), np.float32)
            dense[np.repeat(np.arange(len(chosen)), sizes), place] = shares
            # Scaled so that one word among fifty still moves the scores.
            text = dense @ embeddings[used] * SCALE
            scores = text @ softmax + bias
            scores -= scores.max(axis=1, keepdims=True)
            p = np.exp(scores)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            p *= np.where(labels[chosen] == 1, TOXIC_WEIGHT, 1.0)[:, None] / len(chosen)
            inner = p @ softmax.T * SCALE
            move("s", softmax, text.T @ p)
            move("b", bias, p.sum(axis=0))
            move("e", embeddings, dense.T @ inner + DECAY * embeddings[used], used)
    towards = softmax[:, 1] - softmax[:, 0]
    return (embeddings @ towards * SCALE).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on the rows of ``docs`` that ``labels (doc_id, toxic)`` covers, see the sample's bounds."""
    known = (
        labels.filter("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    sample = [
        known.filter(F.col("toxic") == kind).orderBy("order", "doc_id").limit(most)
        for kind, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))
    ]
    # At most MAX_TOXIC + MAX_CLEAN ids.
    chosen = F.broadcast(sample[0].unionAll(sample[1]).select("doc_id", "toxic", "order"))
    digest = F.struct(F.xxhash64("text").alias("h"), F.col("text"))
    texts = (
        docs.select("doc_id", "text")
        .join(chosen, "doc_id")
        .groupBy("doc_id", "toxic", "order")
        .agg(F.min(digest)["text"].alias("text"))
    )
    bags = durable(_bags(texts.select("doc_id", "toxic", "order", "text")), "bags")
    # A window over the sample's ids and sizes alone.
    before = Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = bags.select("doc_id", "order", F.octet_length("buckets").alias("size"))
    small = sizes.withColumn("sum", F.sum("size").over(before)).filter(F.col("sum") <= 2 * MAX_ENTRIES).select("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Views of the batches as they came: a sorted table would hold every bag twice.
        rows = []
        for batch in pieces(batches):
            views = [[np.frombuffer(x.as_buffer(), kind) for x in batch.column(k)] for k, kind in ((3, np.uint16), (4, np.float32))]
            rows += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *views)
        rows.sort(key=lambda r: r[0])
        towards, bias = fit([r[2:] for r in rows], np.array([r[1] for r in rows], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([towards.tobytes()], pa.binary()), pa.array([bias])], names=["towards", "bias"])

    sampled = bags.join(F.broadcast(small), "doc_id").select(*_BAGS.names).repartition(1)
    # One row: a number for each bucket.
    row = sampled.mapInArrow(run, "towards binary, bias double").first()
    # None if there is nothing to learn from.
    return (np.frombuffer(row["towards"], np.float32), row["bias"]) if row else fit([], np.zeros(0, np.int64))


_BAGS = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("order", pa.int64()), ("buckets", pa.binary()), ("shares", pa.binary())])


def _bags(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [bag(x.as_py()) for x in batch.column(3)]
            bodies = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *bodies], names=_BAGS.names)

    return texts.mapInArrow(run, "doc_id long, toxic int, order long, buckets binary, shares binary")


class _WordScores(dict):
    """Score of a word, the mean over its buckets."""

    def __init__(self, by_bucket: np.ndarray):
        super().__init__()
        self.by_bucket = by_bucket

    def learn(self, words: set[bytes]) -> None:
        """Have the scores of these words at hand; the new ones are worked out together."""
        new = [w for w in words if w not in self]
        if new:
            if len(self) + len(new) > WORD_CACHE:
                self.clear()
                new = words
            ordered, owner, buckets = buckets_of(new)
            self.update(zip(ordered, (np.bincount(owner, self.by_bucket[buckets]) / np.bincount(owner)).tolist()))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of the toxic class; a column of that name is replaced."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket, bias = shared.value
        scores = _WordScores(by_bucket)
        for batch in pieces(batches):
            sums = []
            texts = batch.column(at)
            for start in range(0, len(texts), TEXTS):
                found = [tokens(x.as_py()) for x in texts.slice(start, TEXTS)]
                scores.learn(set().union(*found))
                sums += [math.fsum(map(scores.__getitem__, f)) / max(FEWEST, len(f)) + bias for f in found]
            p = 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from training: a third of all ids; a null id is not held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def training_rows(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out(F.col("doc_id")))
