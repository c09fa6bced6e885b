"""Log-bilinear probabilities of all training words beyond the most frequent ones.

The class model of ``lm_scoring`` knows the most frequent words; all others are one of
its classes. Here that class is cut further, down to single words, so that each training
word has a vector and a bias of its own, however many there are:

* words whose counts are broadcast are dealt by rank to ``g`` groups of ``g`` words at most;
  the class has these groups, and one more for the words beyond, as children;
* the words beyond are dealt by their hash: ``b`` shards, ``b`` groups in each, and the words
  of a group, with ``b`` the cube root of their number.

At every cut the children's probabilities are a softmax of their vectors times the
predicted one, which the class model's context vectors give, so those of all words sum to
one; an unseen word has its smoothed share of the class. Vectors are trained by
noise-contrastive estimation, with the noise by its expectation, from zero: without any
count of a context, children have their smoothed shares.

Words in their contexts are counted over all training texts. They travel packed, to as many tasks as
there are shards; what is known of a task's groups as a whole is no larger than contexts times
groups. Vectors of broadcast words are broadcast too; those of the others stay in their shards, and
their occurrences go there to be scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.llm.common import ROW_KEY
from citesift.session import durable

# Passes over all counts, and steps at least.
PASSES, STEPS = 4, 16
NOISE = 32
RATE = 0.3
# Counts that a vector's steps are held back by.
HELD = 30.0
# Contexts times children worked on at once.
CELLS = 1 << 19
# Parents of the two cuts whose children are no words.
CLASS, BEYOND = -1, -2


@dataclass
class Cut:
    """Vectors and biases of the children, by ``keys``."""

    keys: np.ndarray
    vectors: np.ndarray
    bias: np.ndarray

    def logs(self, features: np.ndarray, row: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the numbers ``child`` in the contexts ``features[row]``."""
        out = np.empty(len(row), np.float32)
        wide = max(CELLS // max(len(self.bias), 1), 1)
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(0, len(features) + wide, wide))
        for k, at in enumerate(range(0, len(features), wide)):
            scores = features[at : at + wide] @ self.vectors.T + self.bias
            top = scores.max(axis=1)
            whole = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
            mine = order[ends[k] : ends[k + 1]]
            out[mine] = scores[row[mine] - at, child[mine]] - whole[row[mine] - at]
        return out


def fit_cut(features: np.ndarray, row: np.ndarray, child: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> Cut:
    """Noise-contrastive estimation with Adagrad of children that were counted in the contexts ``features[row]``."""
    m = len(keys)
    noise = np.bincount(child, weights=counts, minlength=m) + 1.0
    noise = (noise / noise.sum()).astype(np.float32)
    vectors, bias = np.zeros((m, features.shape[1]), np.float32), np.log(noise)
    if m < 2:
        return Cut(keys, vectors, bias)
    past, past_bias = np.full_like(vectors, HELD), np.full_like(bias, HELD)
    # Real words as often as they were counted, and so many times that of noise; a step has a chunk of contexts.
    wide = max(CELLS // m, 1)
    order = np.argsort(row, kind="stable")
    row, child, counts = row[order], child[order], counts[order].astype(np.float32)
    parts = np.unique(np.append(np.arange(0, len(features), wide), len(features)))
    ends = np.searchsorted(row, parts)
    shift = np.log(NOISE * noise)
    for _ in range(max(PASSES, -(-STEPS // (len(parts) - 1)))):
        for k in range(len(parts) - 1):
            x = features[parts[k] : parts[k + 1]]
            mine = slice(ends[k], ends[k + 1])
            r, c, n = row[mine] - parts[k], child[mine], counts[mine]
            d = x @ vectors.T
            d += bias - shift
            real = 1 / (1 + np.exp(-d))
            d = np.bincount(r, weights=n, minlength=len(x)).astype(np.float32)[:, None] * (NOISE * noise) * real
            # Each child is counted once for a context.
            d[r, c] += n * (real[r, c] - 1)
            for name, g in ((vectors, d.T @ x), (bias, d.sum(axis=0))):
                kept = past if name is vectors else past_bias
                kept += g**2
                name -= RATE * g / np.sqrt(kept)
    return Cut(keys, vectors, bias)


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the columns, the first one first, and where a new combination begins in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.flatnonzero(new)


def _numbered(ctx: np.ndarray, child: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different contexts, and per context and child the context's place, the child and the sum of ``n``."""
    wide = int(ctx.max(initial=0)) + 1
    code = ctx + child.astype(np.int64) * wide
    order = np.argsort(code)
    code = code[order]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else order
    child, ctx = np.divmod(code[at], wide)
    there = np.zeros(wide, bool)
    there[ctx] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[ctx], child, np.add.reduceat(n[order], at) if len(at) else n


@dataclass
class Deal:
    """How other words lie in groups: ``n`` broadcast ones by their ranks, ``beyond`` words that are not by their hashes."""

    n: int
    beyond: int

    def __post_init__(self):
        self.groups = int(np.ceil(np.sqrt(self.n)))
        self.parts = int(np.ceil(np.cbrt(self.beyond)))

    def size(self, group: int) -> int:
        return len(range(group, self.n, self.groups))


def packed_counts(rank: np.ndarray, hashes: np.ndarray, ctx: np.ndarray, deal: Deal) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """``shard, word, ctx, n`` of other words, a row per shard: ranks of broadcast words, hashes of those with rank -1."""
    wide = int(ctx.max(initial=0)) + 1
    inside = rank >= 0
    if inside.any():
        group, child = rank[inside] % deal.groups, rank[inside] // deal.groups
        code, times = np.unique((group * (deal.n + 1) + child) * wide + ctx[inside], return_counts=True)
        word, own = np.divmod(code, wide)
        group, child = np.divmod(word, deal.n + 1)
        yield from _packed(group, child * deal.groups + group, own, times)
    if not inside.all():
        hashes, ctx = hashes[~inside], ctx[~inside]
        part = hashes % deal.parts
        order, at = runs(part, hashes, ctx)
        times, order = np.diff(np.append(at, len(order))), order[at]
        yield from _packed(deal.groups + part[order], hashes[order], ctx[order], times)


def _packed(shard: np.ndarray, word: np.ndarray, ctx: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    ctx, times = ctx.astype(np.int32), times.astype(np.int32)
    ends = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
    for a, b in zip(ends, ends[1:]):
        yield int(shard[a]), word[a:b].tobytes(), ctx[a:b].tobytes(), times[a:b].tobytes()


PACKED = pa.schema([("shard", pa.int32()), ("word", pa.binary()), ("ctx", pa.binary()), ("n", pa.binary())])
_CUT = "keys binary, vectors binary, bias binary"
_TRAINED = f"shard int, {_CUT}, counts binary, parts binary, part_vectors binary, part_bias binary, ctx binary, n binary"


def _joined(values: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind)


def _bytes(cut: Cut) -> list[bytes]:
    return [cut.keys.astype(np.int64).tobytes(), cut.vectors.tobytes(), cut.bias.tobytes()]


def _cut(keys: bytes, vectors: bytes, bias: bytes) -> Cut:
    b = np.frombuffer(bias, np.float32)
    return Cut(np.frombuffer(keys, np.int64), np.frombuffer(vectors, np.float32).reshape(len(b), -1), b)


def train_words(features: np.ndarray, deal: Deal, shard: int, word: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> list:
    """The cuts of a shard down to its words, and how often it was counted in each context, as ``_TRAINED`` without the shard."""
    if shard < deal.groups:
        seen, row, child, sums = _numbered(ctx, word // deal.groups, n)
        cut = fit_cut(features[seen], row, child, sums, np.arange(deal.size(shard)))
        rest = [b"", b"", b"", b""]
    else:
        words, place = np.unique(word, return_inverse=True)
        part = words // deal.parts % deal.parts
        order = np.argsort(part, kind="stable")
        parts, number = np.unique(part, return_inverse=True)
        seen, row, child, sums = _numbered(ctx, number[place], n)
        upper = fit_cut(features[seen], row, child, sums, parts)
        counts = np.bincount(place, weights=n, minlength=len(words)).astype(np.int64)
        # Words of a part lie together; what was counted of them is cut out by sorting once.
        at = np.argsort(number[place], kind="stable")
        ends = np.searchsorted(number[place][at], np.arange(len(parts) + 1))
        found = []
        for k in range(len(parts)):
            mine = at[ends[k] : ends[k + 1]]
            own, child = np.unique(place[mine], return_inverse=True)
            here, row, child, sums_ = _numbered(ctx[mine], child, n[mine])
            found.append(fit_cut(features[here], row, child, sums_, words[own]))
        cut = Cut(words[order], np.concatenate([f.vectors for f in found]), np.concatenate([f.bias for f in found]))
        rest = [counts[order].tobytes(), *_bytes(upper)]
    total = np.bincount(ctx, weights=n)
    contexts = np.flatnonzero(total)
    return [*_bytes(cut), *rest, contexts.astype(np.int32).tobytes(), total[contexts].astype(np.int64).tobytes()]


@dataclass
class Words:
    """The cuts that are broadcast, and how the other ones are found."""

    deal: Deal
    features: np.ndarray
    # Of the class, down to the groups; of the words beyond, down to their shards.
    top: Cut
    beyond: Cut | None
    groups: list[Cut]
    # log10 of what an unseen word leaves.
    seen: float

    def logs(self, rank: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """log10 probability, within the class, of broadcast words in their contexts."""
        out = np.zeros(len(rank))
        child, group = np.divmod(rank, max(self.deal.groups, 1))
        order = np.argsort(group.astype(np.int16), kind="stable")
        ends = np.searchsorted(group[order], np.arange(self.deal.groups + 1))
        for k in range(self.deal.groups):
            mine = order[ends[k] : ends[k + 1]]
            if len(mine):
                seen, row = np.unique(ctx[mine], return_inverse=True)
                found = self.groups[k].logs(self.features[seen], row, child[mine]) + self._top(seen, k)[row]
                out[mine] = found / np.log(10) + self.seen
        return out

    def _top(self, ctx: np.ndarray, child: int) -> np.ndarray:
        return self.features[ctx] @ self.top.vectors[child] + self.top.bias[child] - self.whole[ctx]

    @property
    def whole(self) -> np.ndarray:
        """Logarithm of the sum over the class's children in each context, worked out once a worker."""
        if not hasattr(self, "_whole"):
            parts = [self.features[a : a + 512] @ self.top.vectors.T + self.top.bias for a in range(0, len(self.features), 512)]
            self._whole = np.concatenate([np.log(np.exp(p - p.max(axis=1, keepdims=True)).sum(axis=1)) + p.max(axis=1) for p in parts])
        return self._whole

    def logs_beyond(self, hashes: np.ndarray, ctx: np.ndarray, shard: int, trained) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words of a shard, 0 if unseen, and their log10 probability within the class."""
        cut = _cut(trained.keys, trained.vectors, trained.bias)
        counts = np.frombuffer(trained.counts, np.int64)
        upper = _cut(trained.parts, trained.part_vectors, trained.part_bias)
        sorted_ = np.argsort(cut.keys)
        at = np.minimum(np.searchsorted(cut.keys[sorted_], hashes), len(sorted_) - 1)
        at = sorted_[at]
        known = np.flatnonzero(cut.keys[at] == hashes)
        at, ctx = at[known], ctx[known]
        times, out = np.zeros(len(hashes), np.int64), np.zeros(len(hashes))
        if not len(known):
            return times, out
        times[known] = counts[at]
        seen, row = np.unique(ctx, return_inverse=True)
        x = self.features[seen]
        here = np.zeros(len(row), np.int64)
        found = self._top(seen, self.deal.groups)[row]
        found += self.beyond.logs(x, row, here + np.searchsorted(self.beyond.keys, shard))
        part = cut.keys // self.deal.parts % self.deal.parts
        number = np.searchsorted(upper.keys, part)
        found += upper.logs(x, row, number[at])
        begin = np.searchsorted(number, np.arange(len(upper.keys) + 1))
        order = np.argsort(number[at], kind="stable")
        ends = np.searchsorted(number[at][order], np.arange(len(upper.keys) + 1))
        for k in np.unique(number[at]):
            mine = order[ends[k] : ends[k + 1]]
            own = slice(begin[k], begin[k + 1])
            few, r = np.unique(row[mine], return_inverse=True)
            found[mine] += Cut(cut.keys[own], cut.vectors[own], cut.bias[own]).logs(x[few], r, at[mine] - begin[k])
        out[known] = found / np.log(10) + self.seen
        return times, out


def fit(counted: DataFrame, deal: Deal, features: np.ndarray, seen: float) -> tuple[Words, DataFrame]:
    """Train on ``counted``, as of ``packed_counts``; the shards of words beyond are the second result."""
    spark = counted.sparkSession
    context = spark.sparkContext
    shared = context.broadcast((features, deal))

    def words(key, body):
        features, deal = shared.value
        word, ctx, n = _joined(body["word"], np.int64), _joined(body["ctx"], np.int32), _joined(body["n"], np.int32)
        return pd.DataFrame([[int(key[0]), *train_words(features, deal, int(key[0]), word, ctx, n)]], columns=names)

    names = [f.split()[0] for f in _TRAINED.split(", ")]
    trained = durable(counted.groupBy("shard").applyInPandas(words, _TRAINED), "lm-words")
    groups = deal.groups

    def upper(key, body):
        # Contexts times children at most, however many words were counted.
        ctx, n = _joined(body["ctx"], np.int32), _joined(body["n"], np.int64)
        child = np.repeat(body["child"].to_numpy(), [len(b) // 4 for b in body["ctx"]])
        features, _ = shared.value
        keys = np.unique(child)
        here, row, number, sums = _numbered(ctx, np.searchsorted(keys, child), n)
        return pd.DataFrame([[int(key[0]), *_bytes(fit_cut(features[here], row, number, sums, keys))]], columns=["parent", *names[1:4]])

    to_class = trained.select(F.lit(CLASS).alias("parent"), F.least("shard", F.lit(groups)).alias("child"), "ctx", "n")
    to_beyond = trained.filter(F.col("shard") >= groups).select(
        F.lit(BEYOND).alias("parent"), (F.col("shard") - groups).alias("child"), "ctx", "n"
    )
    # Two rows, and a row for each of the broadcast groups.
    cuts = to_class.unionAll(to_beyond).groupBy("parent").applyInPandas(upper, f"parent int, {_CUT}").collect()
    cuts = {r["parent"]: _cut(r["keys"], r["vectors"], r["bias"]) for r in cuts}
    lower = trained.filter(F.col("shard") < groups).select("shard", *names[1:4]).orderBy("shard").collect()
    model = Words(
        deal, features, cuts.get(CLASS), cuts.get(BEYOND), [_cut(r["keys"], r["vectors"], r["bias"]) for r in lower], seen
    )
    beyond = trained.filter(F.col("shard") >= groups).select(
        (F.col("shard") - groups).alias("part"), *names[1:4], "counts", "parts", "part_vectors", "part_bias"
    )
    return model, beyond


def beyond_scores(occurrences: DataFrame, beyond: DataFrame, model, parts: int) -> DataFrame:
    """``rare_known, rare_logs, rare_model`` by row, over ``occurrences (_id, _tk, h, ctx, times)``.

    Of words that were seen in training: their number, the sum of log10 of their counts and one,
    and the sum of their log10 probabilities within the class. ``model`` is broadcast.
    """

    def run(key, left, right):
        columns = [*ROW_KEY, "rare_known", "rare_logs", "rare_model"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        hashes, ctx, times = (left[k].to_numpy() for k in ("h", "ctx", "times"))
        counts, logs = model.value[1].logs_beyond(hashes, ctx, int(key[0]), next(right.itertuples(index=False)))
        kept = counts > 0
        sums = pd.DataFrame({
            **{k: left[k].to_numpy()[kept] for k in ROW_KEY},
            "rare_known": times[kept].astype(np.int64),
            "rare_logs": (times * np.log10(counts + 1.0))[kept],
            "rare_model": (times * logs)[kept],
        })
        return sums.groupby(ROW_KEY, as_index=False).sum()[columns]

    dealt = occurrences.withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    found = dealt.groupBy("part").cogroup(beyond.groupBy("part")).applyInPandas(
        run, "_id long, _tk long, rare_known long, rare_logs double, rare_model double"
    )
    return found.groupBy(*ROW_KEY).agg(*(F.sum(k).alias(k) for k in ("rare_known", "rare_logs", "rare_model")))
