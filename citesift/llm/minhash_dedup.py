"""Near-duplicate texts by circulant MinHash, confirmed on whole shingle sets.

One permutation spreads the shingles over a universe of ``UNIVERSE`` places; a
second one, shifted circularly by k, gives the k-th signature coordinate. The
coordinates are cut into ``BANDS`` bands of ``ROWS``. Two sets of similarity 0.75
share no band with a chance of (1 - 0.75**4)**36, about 1e-6.

Texts with equal sets are one class from the start, so copies are never compared.
Within a bucket (the classes that share a band) only stars are compared: a centre
with every class not yet in its component; centres are the classes that share most
buckets with others, such as the text that copies were made from. The first round
uses a few bands only and joins most copies.

Buckets that still hold several components are then split by rare shingles. In any
one order of all shingles, two sets that are similar enough share one of their
first quarter (``leading``), so classes in open buckets meet again under each of
those only; the smaller set has the shingle in its first seventh, so only such
members become centres. With frequent shingles last in the order, unlike texts around
a common passage no longer meet. Centres that have met all others leave their group, and
the rounds go on until no group holds two components. So no pair that could join
two components is left out, and all pairs of a group are never listed.

Shingles are hashed to 64 bits; a class is known by 64 bits of the digest of its
sorted set (with 10 billion classes, two or three of them would meet by chance).

A text with fewer than five words has its whole word sequence as its only
shingle. Null, empty and wordless texts have no set and stay alone. Repeated rows
and equal texts fall in one class. A component's id is its smallest ``doc_id``;
null ids are passed over, and only a component without any other id has a null
one. ``kept`` compares null-safely. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.common import ROW_KEY, components, keyed, packed, pieces, release, scratch, unpacked
from citesift.session import durable

SHINGLE = 5
PERCENT = 75
BANDS = 36
ROWS = 4
# Bands of the first round, and the centres of a bucket by round; the last number holds on.
FIRST_BANDS = 6
CENTRES = (1, 1, 64, 512)
# Shingles that the order puts last, the most frequent ones. The order decides how many
# texts meet, never which pairs are found.
KNOWN_FREQUENT = 1 << 18
UNIVERSE = 1 << 20
SEED = 20240611
# Words remembered per worker, and shingles handled at once.
WORD_CACHE = 1 << 17
CHUNK = 4096


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()
_TABLES: dict[str, np.ndarray] = {}


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the rows of the second under all shifts in use."""
    if not _TABLES:
        rng = np.random.default_rng(SEED)
        _TABLES["spread"] = rng.permutation(UNIVERSE).astype(np.int32)
        ring = rng.permutation(UNIVERSE).astype(np.int32)
        wide = np.concatenate([ring, ring[: BANDS * ROWS]])
        _TABLES["shifted"] = np.lib.stride_tricks.sliding_window_view(wide, BANDS * ROWS)
    return _TABLES["spread"], _TABLES["shifted"]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    # bytes.lower() and bytes.split() know ASCII only, as the word pattern does.
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(hashed.tobytes(), n)], np.uint64)
    total = np.zeros(n - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        total += hashed[j : n - SHINGLE + 1 + j] * _FACTORS[j]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    spread, shifted = _permutations()
    places = spread[(hashes & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    least = np.full(BANDS * ROWS, UNIVERSE, np.int32)
    for i in range(0, len(places), CHUNK):
        np.minimum(least, shifted[places[i : i + CHUNK]].min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = _mix(key + rows[:, j] + np.uint64(1))
    return key.view(np.int64)


def _class_of(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64)))


_SIGNED = "_id long, _tk long, doc_id long, n long, cls long, bands array<long>"


def signed(docs: DataFrame) -> DataFrame:
    """``_id, _tk, doc_id, n, cls, bands``; a text without words has no class and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, cls, bands = [], [], []
            for text in batch.column(3):
                found = shingles(text.as_py())
                n.append(len(found))
                cls.append(_class_of(found) if len(found) else None)
                bands.append(band_keys(signature(found)) if len(found) else None)
            columns = [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(cls, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bands, pa.list_(pa.int64()))], names=["_id", "_tk", "doc_id", "n", "cls", "bands"]
            )

    return keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SIGNED)


def _sets(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``cls, n, hashes`` of the classes asked for, from one row of each class."""
    chosen = rows.join(classes, "cls", "left_semi").groupBy("cls")
    chosen = chosen.agg(F.min_by("_id", "_tk").alias("_id"), F.min("_tk").alias("_tk"))
    # A row that occurs twice would give its class twice.
    texts = keyed(docs, "text").join(chosen, ROW_KEY).dropDuplicates(ROW_KEY).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [shingles(x.as_py()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["cls", "n", "hashes"],
            )

    return texts.mapInArrow(run, "cls long, n long, hashes array<long>")


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, rising, and counts of the shingles found most often together in a batch; at most ``KNOWN_FREQUENT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1])], names=["h", "n"])

    counts = sets.select("hashes").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "h").limit(KNOWN_FREQUENT).toArrow().sort_by("h")
    return top["h"].to_numpy(), top["n"].to_numpy()


def leading(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The rarest shingles of a set, so many that no similar set can do without all of them."""
    known, counts = frequent
    rank = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        rank = np.where(known[at] == hashes, counts[at], 0)
    most = len(hashes) + (-percent * len(hashes)) // 100 + 1
    return hashes[np.lexsort((hashes, rank))[:most]]


def rare_groups(members: DataFrame, sets: DataFrame, known: DataFrame | None) -> DataFrame:
    """``key, cls, weight, n, at``: classes of the open buckets by shared leading shingles and their place."""
    placed = _placed(members, known)
    chosen = placed.join(_open(placed), "key").select("cls", "weight", "n").distinct()
    frequent = sets.sparkSession.sparkContext.broadcast(frequent_shingles(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keys = [leading(x.values.to_numpy(zero_copy_only=False), frequent.value) for x in batch.column(3)]
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            columns = [pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))]
            columns += [batch.column(c).take(pa.array(at)) for c in range(3)]
            columns.append(pa.array(np.concatenate([np.arange(len(k)) for k in keys] or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "cls", "weight", "n", "at"])

    sided = chosen.join(sets.select("cls", "hashes"), "cls").select("cls", "weight", "n", "hashes")
    return scratch(sided.mapInArrow(run, "key long, cls long, weight long, n long, at long"), "near-rare")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``pairs (a, b, ...)`` whose whole sets are similar enough."""
    common = F.size(F.array_intersect("ha", "hb"))
    return (
        pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("ha")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("hb")), "b")
        .filter(common * 100 >= (F.size("ha") + F.size("hb") - common) * percent)
        .select(*pairs.columns)
    )


def _components_of(links: DataFrame, known: DataFrame | None) -> DataFrame:
    """Fold new links between components into ``known (cls, comp)``."""
    merged = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = merged.select(F.col("node").alias("comp"), F.col("component").alias("to"))
    if known is None:
        return scratch(merged.select(F.col("comp").alias("cls"), F.col("to").alias("comp")), "near-components")
    old = known.join(merged, "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp"))
    # Classes that were alone so far.
    new = merged.join(known, merged["comp"] == known["cls"], "left_anti").select(
        F.col("comp").alias("cls"), F.col("to").alias("comp")
    )
    return scratch(old.unionAll(new), "near-components")


def linked(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """``cls, comp`` of all classes linked with another one; None if there is none."""
    classes = (
        rows.filter("cls is not null").groupBy("cls").agg(F.first("bands").alias("bands"), F.first("n").alias("n"))
    )
    banded = classes.select("cls", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n"))
    members = scratch(banded.join(shared.filter("lo <> hi").select("key", "n"), "key"), "near-buckets")
    if members.isEmpty():
        return None
    # How many meetings a class has; the low bits tell equal ones apart.
    weights = members.groupBy("cls").agg(F.sum("n").alias("w"))
    weights = weights.select("cls", F.expr("w * 1048576 + (cls & 1048575)").alias("weight"))
    sets = scratch(_sets(docs, rows, weights.select("cls")), "near-sets")
    weights = weights.join(sets.select("cls", "n"), "cls")
    weighted = scratch(members.select("key", "cls", "band").join(weights, "cls"), "near-members")
    release(members)
    # A bucket says nothing about where its members agree.
    members = weighted.withColumn("at", F.lit(0).cast("long"))
    known, first = _round(members.filter(F.col("band") < FIRST_BANDS).drop("band"), None, sets, 0)
    release(first)
    left = rare_groups(members, sets, known)
    release(weighted)
    turn = 1
    while left is not None:
        before = left
        known, left = _round(left, known, sets, turn)
        release(before)
        turn += 1
    release(sets)
    return known


def _placed(members: DataFrame, known: DataFrame | None) -> DataFrame:
    """``members`` with the component ``comp`` of each class."""
    if known is None:
        return members.withColumn("comp", F.col("cls"))
    return members.join(known, "cls", "left").select(*members.columns, F.coalesce("comp", "cls").alias("comp"))


def _early() -> Column:
    """Whether a set can be the smaller one of a similar pair whose first common shingle this is."""
    return (F.col("n") - F.col("at")) * (100 + PERCENT) >= F.col("n") * (2 * PERCENT)


def _open(placed: DataFrame) -> DataFrame:
    """Keys of the groups with more than one component and a member to compare the others with."""
    ends = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(_early()).alias("early"))
    return ends.filter("early and lo <> hi").select("key")


def _round(members: DataFrame, known: DataFrame | None, sets: DataFrame, turn: int):
    """Compare each group's centres with the members of other components.

    Returns the components so far and the members that still have to meet others.
    """
    placed = _placed(members, known)
    open_rows = placed.join(_open(placed), "key").withColumn(
        "part", F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(CENTRES[min(turn, len(CENTRES) - 1)]))
    )
    open_rows = scratch(open_rows, "near-open")
    if open_rows.isEmpty():
        release(open_rows)
        return known, None
    centre = F.max_by(F.struct("cls", "comp", "n", "at"), "weight")
    chosen = open_rows.filter(_early()).groupBy("key", "part").agg(centre.alias("c"))
    met = open_rows.join(chosen.select("key", "c"), "key").filter("comp <> c.comp")
    # Sizes first: sets move only for pairs whose sizes allow the similarity.
    met = met.filter(F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * PERCENT)
    # Where this is their first common shingle, they share no more than what follows it.
    rest = F.least(F.col("n") - F.col("at"), F.col("c.n") - F.col("c.at"))
    met = met.filter(rest * (100 + PERCENT) >= (F.col("n") + F.col("c.n")) * PERCENT)
    ours, theirs = F.struct("cls", "comp"), F.struct("c.cls", "c.comp")
    pair = met.select(F.least(ours, theirs).alias("x"), F.greatest(ours, theirs).alias("y")).distinct()
    pair = pair.select(
        F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")
    )
    links = scratch(confirmed(pair, sets).select("ca", "cb").distinct(), "near-links")
    # A centre has met every other component of its group.
    rest = open_rows.join(chosen.select("key", F.col("c.cls").alias("cls")), ["key", "cls"], "left_anti")
    rest = scratch(rest.select("key", "cls", "weight", "n", "at"), "near-rest")
    release(open_rows)
    if not links.isEmpty():
        before, known = known, _components_of(links, known)
        release(before)
    release(links)
    return known, rest


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``_id, _tk, comp, doc_id, n_shingles, component_id, kept``, a row for each row of ``docs``."""
    rows = durable(signed(docs), "near-signed")
    known = linked(docs, rows)
    narrow = rows.select("_id", "_tk", "doc_id", "n", "cls")
    if known is None:
        narrow = narrow.withColumn("comp", F.col("cls"))
    else:
        narrow = narrow.join(known, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    # Texts without words have no class: they are left out here and stay alone.
    least = narrow.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    placed = narrow.join(least, "comp", "left").withColumn(
        "component_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    )
    return placed.select(
        "_id",
        "_tk",
        "comp",
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest id; wordless texts all stay."""
    kept = durable(near_duplicates(docs).filter("kept"), "near-kept")
    one = kept.filter("comp is not null").groupBy("comp").agg(F.min_by("_id", "_tk").alias("_id"), F.min("_tk").alias("_tk"))
    rows = packed(docs)
    worded = F.coalesce(F.col("_row.text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    chosen = rows.filter(worded).join(one, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
    return unpacked(chosen.select(*rows.columns).unionAll(rows.filter(~worded)), docs.columns, {})
