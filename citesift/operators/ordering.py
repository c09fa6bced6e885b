"""Global ranks and running sums without a one-task window.

``Window.orderBy`` without a partition key, or with a hot one, sends every row
to one task. Here rows are range-partitioned on the whole sort key, which ends
in a unique id or is itself unique, so ties and hot groups split too; each slice
is handled on its own, and only one row per slice and group is combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.session import durable

# monotonically_increasing_id() is (partition << 33) + position in the partition.
_POSITION_BITS = 33


def _sliced(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Rows with ``_slice`` (rising along ``keys``) and ``_pos`` within the slice.

    Written out, because range bounds are sampled and a second evaluation could
    cut elsewhere.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    position = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(slices, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", position)
    )
    placed = placed.withColumn("_slice", F.shiftright("_at", _POSITION_BITS)).withColumn(
        "_pos", F.col("_at").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    )
    return durable(placed.drop("_at"), "slices")


def _keys(group: Sequence[str], order: Sequence[Column]) -> list[Column]:
    return [F.col(g).asc() for g in group] + list(order)


def _join_on(group: Sequence[str]) -> list[str]:
    return ["_slice", *group]


def global_rank(
    df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Add the 1-based rank along ``order`` within ``group``. Keys must be unique."""
    placed = _sliced(df, _keys(group, order))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*_join_on(group))
        .agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1)
        .drop("_n", "_first")
    )
    return (
        placed.join(offsets, _join_on(group))
        .withColumn(name, F.col("_shift") + F.col("_pos"))
        .drop("_slice", "_pos", "_shift")
    )


def running_sums(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], group: Sequence[str] = ()
) -> DataFrame:
    """Add inclusive running sums ``{new column: summed column}`` along ``order``."""
    placed = _sliced(df, _keys(group, order))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*_join_on(group)).agg(
        *[F.sum(c).alias(f"_sum_{new}") for new, c in sums.items()]
    )
    offsets = offsets.select(
        *_join_on(group),
        *[F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_off_{new}") for new in sums],
    )
    local = Window.partitionBy(*_join_on(group)).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"_loc_{new}": F.sum(c).over(local) for new, c in sums.items()})
    return (
        summed.join(offsets, _join_on(group))
        .withColumns({new: F.col(f"_off_{new}") + F.col(f"_loc_{new}") for new in sums})
        .drop("_slice", "_pos", *[f"_{p}_{new}" for p in ("off", "loc") for new in sums])
    )


def attach(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of ``totals``, which has one row per group, or just one row.

    The single row comes as a scalar subquery, without a join.
    """
    if by:
        return df.join(totals, list(by))
    row = totals.select(F.struct("*").alias("row")).scalar()
    return df.withColumns({c: row[c] for c in totals.columns})


def hash_rank(
    df: DataFrame,
    seed: int,
    id_col: str = "article_id",
    group: Sequence[str] = (),
    name: str = "rank",
    hash_digits: int = 4,
) -> DataFrame:
    """0-based rank of every row in a seeded random order within ``group``.

    The order is that of ``md5(seed:id)``. Digests are uniform, so their leading
    digits are an even, deterministic range partitioning: a hot group spreads over
    ``16 ** hash_digits`` buckets and nothing has to be sampled or written out.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    keyed = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, hash_digits))
    on = [*group, "_b"]
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*on)
        .agg(F.count("*").alias("_n"))
        .select(*on, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    local = F.row_number().over(Window.partitionBy(*on).orderBy("_h", id_col))
    return (
        keyed.withColumn("_loc", local)
        .join(offsets, on)
        .withColumn(name, F.col("_off") + F.col("_loc") - 1)
        .drop("_h", "_b", "_off", "_loc")
    )
