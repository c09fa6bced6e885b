"""Helpers shared by the text operators: row keys, words in Catalyst, components."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.session import durable

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Fixed by the contract: a word is a run of ASCII letters and digits and of anything beyond ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """Lower-cased words of a text as an array; a null text has none."""
    # Cutting between words takes about a quarter of the time of matching each word.
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


# Rows that a Python worker handles at once.
PIECE = 512


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``PIECE`` rows; at the end the worker, which is kept, gives unused memory back."""
    for batch in batches:
        for start in range(0, len(batch), PIECE):
            yield batch.slice(start, PIECE)
    pa.default_memory_pool().release_unused()


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``durable``, for a table that ``release`` deletes once later tables no longer need it."""
    kept = durable(df, name)
    files = kept.inputFiles()
    kept.scratch_path = os.path.dirname(files[0]) if files else None
    return kept


def release(*tables: DataFrame | None) -> None:
    """Delete scratch tables. Only for tables that no frame in use reads any more."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            jvm = table.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            table.scratch_path = None


# Stands for a null id in row keys; the digest tells it from a real one.
NO_ID = -(2**63)


def _key(docs: DataFrame) -> list[Column]:
    return [
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(docs["doc_id"], docs["text"]).alias("_tk"),
    ]


ROW_KEY = ["_id", "_tk"]


def keyed(docs: DataFrame, *columns) -> DataFrame:
    """``_id, _tk`` and the chosen columns.

    A row is told apart by its id and a digest of id and text, so rows with a
    null id or an id used twice keep their own results, and exact repetitions of
    a row share one.
    """
    return docs.select(*_key(docs), *columns)


def packed(docs: DataFrame) -> DataFrame:
    """``_row, _id, _tk``: all columns in one, so that none of their names can clash."""
    return docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("_row"),
        *_key(docs),
    )


def unpacked(rows: DataFrame, columns: list[str], added: dict[str, Column]) -> DataFrame:
    """The packed ``columns`` without those that ``added`` replaces, and ``added``."""
    old = [F.col("_row")[c].alias(c) for c in columns if c not in added]
    return rows.select(*old, *(c.alias(name) for name, c in added.items()))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``; the component is its smallest node.

    Large-star and small-star steps in turn: edges never outnumber those given,
    a hub's edges are spread by the adaptive joins, and each step is written
    out, so a lost executor repeats one step at most. Ends when every edge
    points from a leaf to its smallest node, after a logarithmic number of steps
    in practice.
    """
    edges = scratch(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    while True:
        before, edges = edges, scratch(_small_star(_large_star(edges)), name)
        release(before)
        seen = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(
            edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
        )
        mixed = seen.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 or c + p > 1")
        if mixed.isEmpty():
            break
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
