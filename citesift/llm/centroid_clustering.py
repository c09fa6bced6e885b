"""Exact integer k-means with the dimensions dealt over shards.

Vectors are cut into blocks of rows and each block into shards of ``SHARD`` columns,
stored once, bucketed by shard and block. In a round

* a task per column block computes exact partial distances against its slice of the
  centroids;
* the blocks of the same rows meet by key, are added, and give the nearest centroid
  (the smaller number on ties);
* the assignments go back to every shard, which sums its columns by cluster and so
  updates its own slice of the centroids, ``floor(sum / count)``; the shards' rows
  themselves never move, because only the other side of a join with a bucketed table
  is shuffled.

Only slices of centroids pass through the driver, ``k`` times the width, however many
vectors there are. A round starts from the stored shards and those slices, so no
lineage builds up and a lost executor repeats tasks of one round. Rounds end early
once the centroids rest, which changes nothing.

Components become integers, ``floor(scale * x)`` in double precision. All arithmetic
is exact: doubles where every sum stays below 2 ** 53, 64-bit integers below 2 ** 63,
unbounded ones above. Integers beyond ``2 ** 62`` are cut to that range, and so are
distances and inertia to that of a long.

Vectors that are null, of another length, or hold null or non-finite components are
left out, and so have no row in the result. Repeated rows are clustered each by
itself; a null id cannot be an initial centroid, but is clustered. With fewer usable
ids than ``k`` there are fewer centroids, with none the result is empty. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.session import durable, scratch_path

SHARD = 16
# Rows of a block; its partial distances are this times k numbers.
BLOCK = 4096
LIMIT = 2**62
LONG = 2**63 - 1
# Bytes of a stored number that fits no machine integer.
WIDE = 24

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * scale), -float(LIMIT), float(LIMIT)).astype(np.int64)


def dump(numbers: np.ndarray) -> bytes:
    """Numbers in the narrowest of four forms; how many bytes each takes tells which."""
    if numbers.dtype == object:
        if all(-LONG <= x <= LONG for x in numbers.ravel().tolist()):
            return dump(numbers.astype(np.int64))
        return b"".join(int(x).to_bytes(WIDE, "little", signed=True) for x in numbers.ravel().tolist())
    most = max(int(numbers.max(initial=0)), -int(numbers.min(initial=0)))
    return numbers.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64).tobytes()


def load(body: bytes, rows: int, columns: int) -> np.ndarray:
    size = len(body) // max(rows * columns, 1)
    if size == WIDE:
        flat = [int.from_bytes(body[i : i + WIDE], "little", signed=True) for i in range(0, len(body), WIDE)]
        return np.array(flat, object).reshape(rows, columns)
    kind = {2: np.int16, 4: np.int32, 8: np.int64}.get(size, np.int64)
    return np.frombuffer(body, kind).astype(np.int64).reshape(rows, columns)


def distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, ``(row, centroid)``."""
    top = max((int(np.abs(x).max(initial=0)) for x in (block, centroids)), default=0)
    bound = 4 * max(block.shape[1], 1) * top * top
    if bound < 2**53:
        a, c = block.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    kind = np.int64 if bound < 2**63 else object
    a, c = block.astype(kind), centroids.astype(kind)
    return np.stack([((a - line) ** 2).sum(axis=1) for line in c], axis=1)


def usable(rows: DataFrame, width: int) -> DataFrame:
    """``vec_id, v`` of the vectors that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].cast("array<double>").alias("v"))
    return vectors.filter(F.size("v") == width).filter(finite)


def initial(vectors: DataFrame, k: int, seed: str, scale: float) -> np.ndarray:
    """The ``k`` vectors with the smallest digest of seed and id, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    # k rows.
    chosen = vectors.filter("vec_id is not null").orderBy(digest, "v").limit(k).collect()
    return integers(np.array([r["v"] for r in chosen], np.float64), scale) if chosen else np.zeros((0, 0), np.int64)


class Shards:
    """The stored column blocks: ``shard, block, n, body``, and ``ids`` in the first shard."""

    def __init__(self, vectors: DataFrame, width: int, scale: float):
        self.spark = vectors.sparkSession
        self.width = width
        self.columns = [(at, min(at + SHARD, width)) for at in range(0, width, SHARD)]
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"shards_{uuid.uuid4().hex}"
        # As few files as there are buckets.
        placed = self._cut(vectors, scale).repartition(buckets, "shard", "block")
        (
            placed.write.bucketBy(buckets, "shard", "block")
            .option("path", scratch_path(self.spark, "shards"))
            .saveAsTable(self.name)
        )
        self.table = self.spark.table(self.name)

    def _cut(self, vectors: DataFrame, scale: float) -> DataFrame:
        columns, width = self.columns, self.width
        schema = pa.schema(
            [("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("body", pa.binary())]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TaskContext.get().partitionId() << 32
            for batch in batches:
                for start in range(0, len(batch), BLOCK):
                    part = batch.slice(start, BLOCK)
                    values = integers(part.column(1).flatten().to_numpy().reshape(len(part), width), scale)
                    ids = part.column(0).to_pylist()
                    rows = [
                        (s, block, len(part), None if s else ids, dump(values[:, a:b])) for s, (a, b) in enumerate(columns)
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    block += 1

        return vectors.mapInArrow(run, "shard int, block long, n int, ids array<long>, body binary")

    def nearest(self, centroids: np.ndarray) -> DataFrame:
        """``block, n, ids, clusters, distances``: partial distances of each column block, added by block."""
        columns = self.columns
        k = len(centroids)
        schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("part", pa.binary())])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = []
                for shard, n, body in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "body"))):
                    a, b = columns[shard]
                    parts.append(dump(distances(load(body, n, b - a), centroids[:, a:b])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("block"), batch.column("n"), batch.column("ids"), pa.array(parts, pa.binary())], schema=schema
                )

        def add(table: pa.Table) -> pa.Table:
            """The column blocks of one block of rows: as many as there are shards."""
            n = table.column("n")[0].as_py()
            total = sum(load(p, n, k).astype(object if len(p) == n * k * WIDE else np.int64) for p in table.column("part").to_pylist())
            best = np.array([int(i) for i in total.argmin(axis=1)], np.int32)
            least = total[np.arange(n), best]
            ids = next(x for x in table.column("ids").to_pylist() if x is not None)
            return pa.table(
                {
                    "block": table.column("block").slice(0, 1),
                    "n": pa.array([n], pa.int32()),
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "clusters": pa.array([best.tobytes()], pa.binary()),
                    "distances": pa.array([dump(least)], pa.binary()),
                }
            )

        parts = self.table.mapInArrow(partial, "block long, n int, ids array<long>, part binary")
        return parts.groupBy("block").applyInArrow(
            add, "block long, n int, ids array<long>, clusters binary, distances binary"
        )

    def sums(self, assigned: DataFrame, k: int) -> DataFrame:
        """``cluster, dim, total, n``: each shard's own sums by cluster."""
        columns = self.columns
        schema = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("total", pa.string()), ("n", pa.int64())])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            counts: dict[int, np.ndarray] = {}
            for batch in batches:
                for shard, n, body, clusters in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "body", "clusters"))):
                    a, b = columns[shard]
                    values, of = load(body, n, b - a), np.frombuffer(clusters, np.int32)
                    total = totals.setdefault(shard, np.zeros((k, b - a), object))
                    kind = np.int64 if n * int(np.abs(values).max(initial=0)) < 2**63 else object
                    here = np.zeros((k, b - a), kind)
                    np.add.at(here, of, values.astype(kind))
                    total += here.astype(object)
                    counts[shard] = counts.get(shard, 0) + np.bincount(of, minlength=k)
            rows = [
                (j, columns[s][0] + i, str(total[j, i]), int(counts[s][j]))
                for s, total in totals.items()
                for j in range(k)
                for i in range(total.shape[1])
                if counts[s][j]
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        # The small side is sent to the shards' buckets.
        sent = assigned.select("block", "clusters", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("shard"))
        met = self.table.select("shard", "block", "n", "body").hint("merge").join(sent.hint("merge"), ["shard", "block"])
        parts = met.select("shard", "n", "body", "clusters").mapInArrow(add, "cluster int, dim int, total string, n long")
        return parts.groupBy("cluster", "dim").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")
        )

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Centroids at the floor of their vectors' mean; empty clusters stay."""
    new = centroids.astype(object)
    # At most one row per centroid and dimension.
    for r in sums.collect():
        new[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return new.astype(np.int64)


def cluster(
    rows: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: float = 1024.0, seed: str = "3"
) -> DataFrame:
    """``RESULT`` for every usable row of ``rows (vec_id, embedding)`` after ``rounds`` rounds."""
    spark = rows.sparkSession
    vectors = usable(rows, width)
    centroids = initial(vectors, k, seed, scale)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    shards = Shards(vectors, width, scale)
    for _ in range(rounds):
        before, centroids = centroids, moved(centroids, shards.sums(shards.nearest(centroids), len(centroids)))
        if (before == centroids).all():
            break
    assigned = durable(_rows(shards.nearest(centroids)), "clusters")
    shards.drop()
    # Decimals, so that no sum of longs overflows; one row per cluster.
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = assigned.groupBy("cluster").agg(exact.alias("_own"))
    total = assigned.agg(exact.alias("_all")).scalar()
    digests = [(j, hashlib.sha256(",".join(map(str, line.tolist())).encode()).hexdigest()) for j, line in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    cut = lambda c: F.least(c, F.lit(LONG).cast("decimal(38,0)")).cast("long")
    return assigned.join(F.broadcast(inertia.join(named, "cluster")), "cluster").select(
        "vec_id", "cluster", "distance", cut(F.col("_own")).alias("cluster_inertia"), cut(total).alias("inertia"), "centroid_sha256"
    )


def _rows(blocks: DataFrame) -> DataFrame:
    """Blocks as one row per vector."""
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, clusters, body in zip(*(batch.column(c).to_pylist() for c in ("ids", "n", "clusters", "distances"))):
                least = [min(int(x), LONG) for x in load(body, n, 1).ravel().tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.frombuffer(clusters, np.int32)), pa.array(least, pa.int64())],
                    schema=schema,
                )

    return blocks.select("ids", "n", "clusters", "distances").mapInArrow(run, "vec_id long, cluster int, distance long")


def sql(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3") -> str:
    """The registered query in SQL, one set of tables for each round."""

    def assigned(at: int) -> str:
        return f"""a{at} as materialized (
  select r, j, d from (
    select r, j, d, row_number() over (partition by r order by d, j) as place from (
      select v.r, c.j, list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q) as d
      from v, c{at} c)) where place = 1)"""

    def updated(at: int) -> str:
        return f"""c{at + 1} as materialized (
  select c.j, coalesce(m.q, c.q) as q from c{at} c left join (
    select j, list(x order by i) as q from (
      select j, i, floor(sum(x) / count(*)) as x
      from (select a.j, unnest(range(1, {width + 1})) as i, unnest(v.q) as x from a{at} a join v using (r))
      group by j, i)
    group by j) m using (j))"""

    steps = [x for at in range(rounds) for x in (assigned(at), updated(at))]
    return f"""with v as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * cast(x as double))) as q
  from embeddings
  where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
c0 as materialized (
  select cast(row_number() over (order by h, q) - 1 as int) as j, q
  from (select sha256('{seed}:' || vec_id) as h, q from v where vec_id is not null order by h, q limit {k})
),
{", ".join(steps)},
{assigned(rounds)}
select vec_id, j as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by j) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(list_transform(c.q, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
from a{rounds} join v using (r) join c{rounds} c using (j)"""
