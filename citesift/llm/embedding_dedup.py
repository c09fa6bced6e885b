"""Near-duplicate vectors by cosine, with PCA-ordered tiles.

Equal vectors are one class, so copies are never compared. Unit vectors are
turned to their principal axes, found from sums over all rows. Two vectors of
cosine c lie within sqrt(2 - 2c) of each other along every axis, so cells of
that width on the first ``CELL_AXES`` axes only meet their neighbours. A cell is
dealt by digest into tiles of about ``TILE`` vectors, and pairs of tiles are the
units of work: large groups are split, and each task holds two tiles.

Inside a pair of tiles the products of the leading ``BLOCK`` axes are summed first;
what the other axes can still add is bounded by the product of the suffix norms.
Pairs that cannot reach the threshold stop there; the others go on block by block
while many are left, and are then decided by the cosine of the vectors as given,
in double precision. A tile pair returns link counts and the edges of a spanning
forest of its links, never the links themselves.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing and are their own component; vectors of different lengths never
link. Repeated rows are copies of each other and count as other vectors. A
component's id is its smallest ``vec_id``; null ids are passed over. Other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.llm.common import components
from citesift.session import durable

THRESHOLD = 0.95
CELL_AXES = 2
TILE = 3000
BLOCK = 8
# Slack of the bounds, far above their rounding errors.
SLACK = 1e-4


def vector_classes(rows: DataFrame) -> DataFrame:
    """``cls, v, copies, least``: distinct usable vectors, their number and their smallest id."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (
        rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        .filter(finite)
        .filter(F.exists("v", lambda x: x != 0))
    )
    # Adding 0.0 makes a negative zero a plain one, so that equal vectors hash alike.
    usable = usable.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    usable = usable.withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    return usable.groupBy("h", "h2").agg(
        F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least")
    )


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay finite.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Axes of the second moments of all unit vectors; tasks return one matrix each, which Spark sums."""

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            u = _unit(np.stack(batch["v"].to_numpy()))
            total += u.T @ u
        yield pd.DataFrame({"at": np.arange(width), "row": list(total)})

    parts = classes.filter(F.size("v") == width).select("v").mapInPandas(moments, "at int, row array<double>")
    summed = parts.select("at", F.posexplode("row").alias("col", "x")).groupBy("at", "col").agg(F.sum("x").alias("x"))
    matrix = np.zeros((width, width))
    # width * width numbers, however many vectors there are.
    for r in summed.collect():
        matrix[r["at"], r["col"]] = r["x"]
    return np.linalg.eigh(matrix)[1][:, ::-1]


def _placed(classes: DataFrame, axes: np.ndarray, reach: float) -> DataFrame:
    width = len(axes)
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def turn(batches):
        for batch in batches:
            u = _unit(np.stack(batch["v"].to_numpy()))
            lead = u @ shared.value[:, :CELL_AXES]
            batch["cell"] = list(np.floor(lead / reach).astype(np.int32))
            yield batch[["cls", "v", "copies", "cell"]]

    rows = classes.filter(F.size("v") == width).select("cls", "v", "copies")
    return rows.mapInPandas(turn, "cls long, v array<double>, copies long, cell array<int>")


def compare(a: pd.DataFrame, b: pd.DataFrame | None, axes: np.ndarray, threshold: float):
    """Links between two tiles, or within one if ``b`` is None, as index arrays."""
    left = np.stack(a["v"].to_numpy())
    right = left if b is None else np.stack(b["v"].to_numpy())
    ul, ur = _unit(left), _unit(right)
    pl = (ul @ axes).astype(np.float32)
    pr = pl if b is None else (ur @ axes).astype(np.float32)
    width = pl.shape[1]

    def suffix(p: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt((p[:, at:].astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)

    at = min(BLOCK, width)
    dots = pl[:, :at] @ pr[:, :at].T
    i, j = np.nonzero(dots + np.outer(suffix(pl, at), suffix(pr, at)) >= threshold - SLACK)
    if b is None:
        i, j = i[i < j], j[i < j]
    some = dots[i, j]
    while at < width and len(i):
        upto = min(at + BLOCK, width)
        some = some + np.einsum("ij,ij->i", pl[i, at:upto], pr[j, at:upto])
        at = upto
        stay = some + suffix(pl, at)[i] * suffix(pr, at)[j] >= threshold - SLACK
        i, j, some = i[stay], j[stay], some[stay]
    stay = np.einsum("ij,ij->i", ul[i], ur[j]) >= threshold
    return i[stay], j[stay]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links of a spanning forest."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for x, y in zip(i.tolist(), j.tolist()):
        a, b = find(x), find(y)
        if a != b:
            root[b] = a
            kept.append((x, y))
    return kept


def tile_pairs(placed: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The rows with their ``tile``, and the pairs ``a, b`` (a <= b) of tiles that can hold links."""
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    sizes = durable(sizes, "cells")
    rows = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    rows = rows.select("cls", "v", "copies", F.struct("cell", "part").alias("tile"))
    tiles = sizes.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = F.col("cell")
    for axis in range(CELL_AXES):
        tiles = tiles.withColumn(f"d{axis}", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    near = F.array(*(F.get("cell", F.lit(k)) + F.col(f"d{k}") for k in range(CELL_AXES)))
    ours = tiles.select(F.struct("cell", "part").alias("a"), near.alias("cell"))
    theirs = sizes.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = ours.join(theirs, "cell").select("a", F.struct("cell", "part").alias("b")).filter("a <= b")
    return rows, pairs


def _links(classes: DataFrame, axes: np.ndarray, threshold: float) -> DataFrame:
    """``cls, n`` (linked vectors of other classes) and ``other``, an edge of a tile pair's forest."""
    # Wider than the reach by the slack, so that rounding moves no pair two cells apart.
    placed = durable(_placed(classes, axes, float(np.sqrt(2 - 2 * threshold)) + SLACK), "vectors-placed")
    rows, pairs = tile_pairs(placed)
    pairs = durable(pairs.withColumn("pair", F.xxhash64("a", "b")), "tile-pairs")
    crossed = pairs.filter("a <> b").select("pair", F.col("b").alias("tile"), F.lit(1).alias("side"), F.lit(True).alias("crossed"))
    sides = pairs.select("pair", F.col("a").alias("tile"), F.lit(0).alias("side"), F.expr("a <> b").alias("crossed"))
    sides = sides.unionAll(crossed)
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a = group[group["side"] == 0].reset_index(drop=True)
        b = group[group["side"] == 1].reset_index(drop=True)
        if not len(a) or not len(b) and group["crossed"].any():
            # One of two tiles is empty.
            return pd.DataFrame({"cls": [], "n": [], "other": []})
        i, j = compare(a, b if len(b) else None, shared.value, threshold)
        inside = not len(b)
        second = a if inside else b
        n = len(a) + (0 if inside else len(b))
        shift = 0 if inside else len(a)
        cls = a["cls"].to_numpy() if inside else np.concatenate([a["cls"].to_numpy(), b["cls"].to_numpy()])
        counts = np.bincount(i, weights=second["copies"].to_numpy()[j], minlength=n)
        counts += np.bincount(j + shift, weights=a["copies"].to_numpy()[i], minlength=n)
        used = np.flatnonzero(counts)
        edges = _forest(i, j + shift, n)
        out = pd.DataFrame({"cls": cls[used], "n": counts[used].astype(np.int64), "other": cls[used]})
        more = pd.DataFrame({"cls": [cls[x] for x, _ in edges], "n": 0, "other": [cls[y] for _, y in edges]})
        return pd.concat([out, more], ignore_index=True) if edges else out

    sided = rows.join(sides, "tile").select("pair", "side", "crossed", "cls", "v", "copies")
    return sided.groupBy("pair").applyInPandas(run, "cls long, n long, other long")


def linked_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each row of ``rows (vec_id, embedding)``."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    found = durable(vector_classes(rows), "vector-classes").withColumn("cls", F.col("h"))
    widths = [r["w"] for r in found.select(F.size("v").alias("w")).distinct().collect()]
    links = None
    for width in sorted(widths):
        part = _links(found, principal_axes(found, width), threshold)
        links = part if links is None else links.unionAll(part)
    keys = found.select("h", "h2", "cls", "copies", "least")
    if links is None:
        keys = keys.withColumns({"n": F.lit(0).cast("long"), "comp": F.col("cls")})
    else:
        links = durable(links, "vector-links")
        counts = links.groupBy("cls").agg(F.sum("n").alias("n"))
        comp = components(links.select(F.col("cls").alias("a"), F.col("other").alias("b")))
        keys = (
            keys.join(counts, "cls", "left")
            .join(comp.select(F.col("node").alias("cls"), F.col("component").alias("comp")), "cls", "left")
            .withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "comp": F.coalesce("comp", "cls")})
        )
    least = keys.groupBy("comp").agg(F.min("least").alias("component_id"))
    keys = keys.join(least, "comp").select("h", "h2", (F.col("n") + F.col("copies") - 1).alias("n"), "component_id")
    plain = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    every = rows.select("vec_id", F.xxhash64(plain).alias("h"), F.xxhash64(F.lit(1), plain).alias("h2"))
    joined = every.join(keys, ["h", "h2"], "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
