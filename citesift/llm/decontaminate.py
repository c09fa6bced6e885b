"""Benchmark passages inside documents, by a prefix-filtered set join.

A window of ten consecutive item words must be contained whole, so one token of
it is enough as the prefix that a joining document has to share. Tokens are
ordered by rarity in the documents; each window is looked up by its rarest one,
and neighbouring windows mostly share it. Document words are joined to the
prefix tokens; each meeting aligns a document position with an item position.
Around it the item's window-sized surroundings are compared word for word, which
verifies every window that holds the position at once; the bounds of both texts
are respected. An item of fewer words, but not none, is one window.

The prefix table is as large as the benchmark, so it is broadcast only if its
rows and words stay below ``BROADCAST_WORDS``; beyond that Spark joins by shuffle.
Document words that are no prefix token stay behind before that: the tokens' hashes,
cut to ``SLOTS`` values, are broadcast, and a word whose value is not among them can
meet nothing. The others travel with their surroundings only, ``2 * WINDOW - 1``
words each, however long the document is.

Null and empty texts have no words and are not hit. Items without words are
ignored, repeated items count once per id, and a null item_id hits but is no
item. Documents are told apart by id and text, null ids too; repeated rows each
get their result; other columns are not read; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.common import NO_ID, ROW_KEY, keyed, packed, unpacked, words
from citesift.session import durable

WINDOW = 10
# Words of the prefix table, surroundings included, up to which it is broadcast.
BROADCAST_WORDS = 2_000_000
# Hash values that tell prefix tokens from other words ahead of the shuffle; bounds their broadcast.
SLOTS = 1 << 21


def _surroundings(array: str, at: str, window: int) -> Column:
    """The words from ``window - 1`` before a position to as many after it; null beyond the ends."""
    return F.transform(
        F.sequence(F.lit(1 - window), F.lit(window - 1)), lambda k: F.get(F.col(array), F.col(at) + k)
    )


def prefix_table(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``token, item_id, at, near, need``: item positions that documents are looked up by.

    ``near`` holds the surrounding item words, ``need`` the length of a window.
    """
    item_words = durable(
        items.select("item_id", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0).distinct(), "items"
    )
    vocabulary = item_words.select(F.explode("ws").alias("w")).distinct()
    vocabulary, small = _measured(vocabulary, F.lit(1))
    vocabulary = F.broadcast(vocabulary) if small else vocabulary
    seen = keyed(docs, words(F.col("text")).alias("ws")).select(F.explode("ws").alias("w"))
    counts = seen.join(vocabulary, "w").groupBy("w").agg(F.count("*").alias("n"))
    need = F.least(F.size("ws"), F.lit(window))
    windows = item_words.select(
        "item_id", "ws", need.alias("need"), F.explode(F.sequence(F.lit(0), F.size("ws") - need)).alias("start")
    )
    tokens = windows.select(
        "item_id",
        "ws",
        "need",
        "start",
        F.explode(F.sequence(F.col("start"), F.col("start") + F.col("need") - 1)).alias("at"),
    ).withColumn("w", F.get("ws", "at"))
    # A window with a word that no document has can't occur.
    ranked = tokens.join(counts, "w", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("item_id", "ws", "need", "start").agg(F.min(F.struct("n", "w", "at")).alias("r"))
    chosen = rarest.filter("r.n > 0").select("item_id", "ws", "need", F.col("r.at").alias("at")).distinct()
    return chosen.select(
        F.get("ws", "at").alias("token"), "item_id", "at", "need", _surroundings("ws", "at", window).alias("near")
    )


def _measured(table: DataFrame, size: Column) -> tuple[DataFrame, bool]:
    """``table`` written out, and whether its measured size allows a broadcast."""
    table = durable(table, "lookup")
    return table, (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_WORDS


# Where the prefix table is broadcast, this stands behind the last word of a document and
# meets a row of its own, so that the pass over the words also gives their number; no word
# holds this character.
_END = "\0"


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_id, _tk, item_id, first, last, n_words``: document words covered by occurring windows.

    Each document also has a row with only ``n_words``, for each of its repetitions.
    """
    prefixes, small = _measured(prefix_table(docs, items, window), F.lit(2 * window))
    rows = keyed(docs, words(F.col("text")).alias("ws"))
    if not small:
        return _hits_by_shuffle(rows, prefixes, window)
    end = prefixes.sparkSession.range(1).select(
        F.lit(_END).alias("token"), *(F.lit(None).cast(prefixes.schema[c].dataType).alias(c) for c in ("item_id", "at")),
        F.lit(0).alias("need"), F.lit(None).cast("array<string>").alias("near"),
    )
    prefixes = F.broadcast(prefixes.unionAll(end))
    placed = rows.select(*ROW_KEY, "ws", F.posexplode(F.concat("ws", F.array(F.lit(_END)))).alias("pos", "token"))
    # Spelled out without a lambda, so that it is compiled together with the join
    # and no row with all words of its document is ever built.
    same = _same([F.get("ws", F.col("pos") + k) for k in range(1 - window, window)])
    joined = placed.join(prefixes, "token").select(*ROW_KEY, "item_id", "pos", "need", same.alias("same"))
    return _runs(joined, window)


def _hits_by_shuffle(rows: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """``hits`` over ``rows (_id, _tk, ws)`` where the prefix table is too large for a broadcast."""
    around = range(1 - window, window)
    slot = F.pmod(F.xxhash64("token"), F.lit(SLOTS)).alias("slot")
    slots = F.broadcast(prefixes.select(slot).distinct())
    placed = rows.select(*ROW_KEY, "ws", F.posexplode("ws").alias("pos", "token")).select("*", slot)
    # Taken before the join, and as columns without a lambda for the same reason as above.
    placed = placed.join(slots, "slot", "left_semi").select(
        *ROW_KEY, "pos", "token", *(F.get("ws", F.col("pos") + k).alias(f"w{k + window - 1}") for k in around)
    )
    same = _same([F.col(f"w{k}") for k in range(2 * window - 1)])
    joined = placed.join(prefixes, "token").select(*ROW_KEY, "item_id", "pos", "need", same.alias("same"))
    found = _runs(joined, window)
    counted = {"n_words": F.size("ws")}
    return found.unionAll(
        rows.select(*(counted.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) if f.name not in ROW_KEY else F.col(f.name) for f in found.schema))
    )


def _same(own: list[Column]) -> Column:
    """A character for each of a document's surrounding words: 1 where the item's is the same."""
    return F.concat(*(F.when(w == F.get("near", F.lit(k)), "1").otherwise("0") for k, w in enumerate(own)))


def _runs(joined: DataFrame, window: int) -> DataFrame:
    """``hits`` of ``joined (_id, _tk, item_id, pos, need, same)``."""
    # The position itself is character ``window`` of ``same``; find the run of equal words that holds it.
    before = F.length(F.substring_index(F.substring("same", 1, window), "0", -1))
    after = F.length(F.substring_index(F.expr(f"substring(same, {window})"), "0", 1))
    run = joined.withColumns({"before": before, "after": after})
    run = run.filter((F.col("need") == 0) | (F.col("before") + F.col("after") - 1 >= F.col("need")))
    hit = F.col("need") > 0
    return run.select(
        *ROW_KEY,
        "item_id",
        F.when(hit, F.col("pos") - F.col("before") + 1).alias("first"),
        F.when(hit, F.col("pos") + F.col("after") - 1).alias("last"),
        F.when(~hit, F.col("pos")).alias("n_words"),
    )


def measured(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_id, _tk, doc_id, n_words, n_hit, items`` for every row; ``items`` are sorted as strings."""
    found = hits(docs, items, window).groupBy(*ROW_KEY)
    spans = F.collect_set(F.when(F.col("first").isNotNull(), F.struct("first", "last")))
    covered = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["last"]))))
    named = found.agg(
        F.count("n_words").alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.size(covered).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    return named.select(
        *ROW_KEY,
        F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"),
        "n_words",
        "n_hit",
        "items",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_id, _tk, n_hit, items`` of the documents that are hit, once each."""
    return measured(docs, items, window).filter("n_hit > 0").select(*ROW_KEY, "n_hit", "items").dropDuplicates(ROW_KEY)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a whole window of an item."""
    rows = packed(docs).join(contamination(docs, items, window), ROW_KEY, "left_anti")
    return unpacked(rows, docs.columns, {})
