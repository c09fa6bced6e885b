"""Where intermediate results that must survive executor loss are kept."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where nothing is set, a temporary folder serves a local session only: on a
    cluster the executors could not read each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="citesift-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Paths of the scratch tables written so far, for ``scratch_scope``.
_written: list[str] = []


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to a scratch Parquet table and continue from the files.

    Cuts the lineage, so a lost executor never recomputes the text work, and
    readers still get column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


def spread(df: DataFrame, parts: int | None, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over ``parts`` tasks; 0 takes as many as the session shuffles in, None leaves it.

    Alone the key decides, so that a task run again gets the same rows.
    """
    if parts is None:
        return df
    return df.repartition(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables written inside when it ends, for jobs whose results are written by then."""
    first = len(_written)
    try:
        yield
    finally:
        for path in _written[first:]:
            delete(spark, path)
        del _written[first:]
