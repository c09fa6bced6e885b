"""Drop lines that many documents share.

Normalised lines are exploded and hashed, the documents of each hash are
counted, and a document is put together again from the positions that stay.
Only digests and positions are shuffled for the counting; whole texts move once,
when the dropped positions of a row are joined to it.

Lines are told apart by two 64-bit hashes of their key. Each row counts as one
document. Null and empty texts have one empty line, which has no key and stays;
a repeated row counts again; rows are told apart by id and text, null ids too;
other columns pass through, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.common import ROW_KEY, ascii_lower, keyed, packed, unpacked

# Fixed by the contract: white space stripped from both ends of a line's key.
STRIPPED = " \t\n\v\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(STRIPPED))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def frequent_lines(docs: DataFrame, min_docs: int, min_length: int = 1) -> DataFrame:
    """``h1, h2`` of the keys of at least ``min_length`` code points in at least ``min_docs`` rows."""
    keys = F.filter(
        F.transform(_lines(ascii_lower(F.col("text"))), _key), lambda k: F.char_length(k) >= min_length
    )
    hashes = docs.select(F.explode(F.array_distinct(F.transform(keys, _hash))).alias("h"))
    return (
        hashes.groupBy("h.h1", "h.h2").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("h1", "h2")
    )


def dropped_positions(docs: DataFrame, min_docs: int, min_length: int = 1) -> DataFrame:
    """``_id, _tk, _dropped``: rising positions of the lines to drop, for rows that have any."""
    placed = (
        keyed(docs, F.posexplode(_lines(ascii_lower(F.col("text")))).alias("pos", "line"))
        .withColumn("key", _key(F.col("line")))
        .filter(F.char_length("key") >= min_length)
        .select("_id", "_tk", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    hit = placed.join(frequent_lines(docs, min_docs, min_length), ["h1", "h2"], "left_semi")
    return hit.groupBy(*ROW_KEY).agg(F.array_sort(F.collect_set("pos")).alias("_dropped"))


def dedup_lines(docs: DataFrame, min_docs: int, min_length: int = 1) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept``, the remaining text.

    Columns of ``docs`` with one of these three names are replaced.
    """
    dropped = dropped_positions(docs, min_docs, min_length)
    rows = packed(docs)
    joined = (
        rows.join(dropped, ROW_KEY, "left")
        .select("_row", "_dropped")
        .withColumn("_lines", _lines(F.col("_row.text")))
    )
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col("_lines"), i)), "\n")
    return unpacked(
        joined,
        docs.columns,
        {
            "n_lines": F.size("_lines").cast("long"),
            "n_dropped": F.coalesce(F.size("_dropped"), F.lit(0)).cast("long"),
            "kept": F.when(F.col("_dropped").isNull(), F.coalesce("_row.text", F.lit(""))).otherwise(kept),
        },
    )
