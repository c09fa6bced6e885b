"""Arrays to rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(
    df: DataFrame, keep: Sequence[str | Column], array: str, name: str, position: str | None = None
) -> DataFrame:
    """One row per element of a computed array column without null elements.

    A plain ``explode`` of a column makes the optimizer add a non-empty filter and
    push it below the projections that compute the column, so the text would be
    tokenised a second time, and before any redistribution. The outer form adds no
    filter; the row it gives for an empty array is dropped afterwards.
    """
    if position:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    else:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())


def _starts(sorted_: str, same: Callable[[Column, Column], Column]) -> Column:
    """Places where a run of equal elements begins in a sorted array column."""
    places = F.when(F.size(sorted_) > 0, F.sequence(F.lit(0), F.size(sorted_) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | ~same(F.get(F.col(sorted_), i), F.get(F.col(sorted_), i - 1)))


def _length(starts: str, sorted_: str, start: Column, number: Column) -> Column:
    return F.coalesce(F.get(F.col(starts), number + 1), F.size(sorted_)) - start


def counted_in_rows(df: DataFrame, array: str, name: str) -> DataFrame:
    """Add ``name``, the different elements of an array column with their numbers ``(value, n)``.

    Elements are sorted and cut into runs within the row, so counting per row needs no
    shuffle. The sorted array and the places are columns of their own: inside a lambda
    an expression would be worked out for every element.
    """
    placed = df.withColumn("_sorted", F.sort_array(F.filter(array, lambda x: x.isNotNull())))
    placed = placed.withColumn("_starts", _starts("_sorted", lambda a, b: a == b))
    runs = F.transform(
        "_starts",
        lambda i, k: F.struct(
            F.get(F.col("_sorted"), i).alias("value"), _length("_starts", "_sorted", i, k).cast("long").alias("n")
        ),
    )
    return placed.withColumn(name, runs).drop("_sorted", "_starts")


def positions_in_rows(df: DataFrame, array: str, name: str, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add ``name``, the different elements of an array column with their rising positions ``(value, at)``.

    With ``wanted``, of the elements that fit only. Works within the row, like ``counted_in_rows``.
    """
    hits = F.transform(array, lambda x, i: F.struct(x.alias("value"), i.alias("at")))
    hits = F.filter(hits, lambda h: h["value"].isNotNull() & (wanted(h["value"]) if wanted else F.lit(True)))
    placed = df.withColumn("_sorted", F.sort_array(hits))
    placed = placed.withColumn("_starts", _starts("_sorted", lambda a, b: a["value"] == b["value"]))
    placed = placed.withColumn("_at", F.transform("_sorted", lambda h: h["at"]))
    runs = F.transform(
        "_starts",
        lambda i, k: F.struct(
            F.get(F.col("_sorted"), i)["value"].alias("value"),
            F.slice("_at", i + 1, _length("_starts", "_sorted", i, k)).alias("at"),
        ),
    )
    return placed.withColumn(name, runs).drop("_sorted", "_starts", "_at")
