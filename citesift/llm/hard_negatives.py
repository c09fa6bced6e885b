"""Hard negatives by exact integer inner products, scored with subset-sum tables.

Components become integers, ``floor(scale * x)``. A candidate is kept as bit planes:
plane ``b`` holds bit ``b`` of all its components, eight of them to a byte, in two's
complement. For an anchor, the sums of all 256 subsets of each eight components are
tabulated once; a byte of a plane then is an index whose entry is the contribution of
eight dimensions at one bit (the method of the four Russians). Adding the entries of
a plane, and planes by shifting the sum so far, gives the whole exact product.

Every anchor meets every candidate in blocks: candidates are dealt evenly over tasks
and stay there, the anchors (a stated query set) are sent to each task, behind its
candidates in sort order, and stream past. A task holds at most about
``MOST_IN_TASK`` packed candidates and ``ANCHORS`` anchors, and returns the best few
of each anchor, so copies of a vector or of a label are never gathered in one place.

An anchor's positives are its best rows of the same label; for each positive, its
negatives are the best rows of other labels with a score inside a band below the
positive's. Higher scores come first, ties by smaller ``vec_id``.

Rows with a null id, label or vector, or with null or non-finite components take no
part. Rows of an anchor's own id are never its partners; rows that repeat an id with
another content count as rows of their own, and an anchor that is repeated gives its
result once for each time. Vectors of different lengths are not compared. Integers
beyond ``2 ** 62`` and scores beyond a long are cut to that range. Other columns are
not read; an empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citesift.session import durable

GROUP = 8
# Rows of one step of the arithmetic, and anchors that share their tables.
CHUNK, ANCHORS = 1024, 128
# Packed candidates a task holds at most; fewer are worth a task of their own from LEAST_IN_TASK on.
MOST_IN_TASK, LEAST_IN_TASK = 1 << 20, 4096
LIMIT = 2**62
LONG = 2**63 - 1


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """``floor(scale * x)`` in double precision, cut to the range of ``LIMIT``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors.astype(np.float64) * scale), -float(LIMIT), float(LIMIT)).astype(np.int64)


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each row in two's complement, sign included."""
    most = np.where(values < 0, ~values, values).max(axis=1, initial=0)
    bits = np.ones(len(values), np.int64)
    while (more := most > 0).any():
        bits += more
        most >>= 1
    return bits


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """``(row, plane, byte)``: bit ``b`` of eight components each in a byte of plane ``b``."""
    planes = [np.packbits(((values >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)]
    return np.stack(planes, axis=1)


def subset_tables(anchors: np.ndarray, dtype) -> np.ndarray:
    """``(group, 256, anchor)``: the sum of every subset of each eight components."""
    count, width = anchors.shape
    groups = max(-(-width // GROUP), 1)
    padded = np.zeros((count, groups * GROUP), dtype)
    padded[:, :width] = anchors
    parts = padded.reshape(count, groups, GROUP)
    tables = np.zeros((groups, 1 << GROUP, count), dtype)
    for bit in range(GROUP):
        half = 1 << bit
        tables[:, half : 2 * half] = tables[:, :half] + parts[:, :, bit].T[:, None, :]
    return tables


def products(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """``(row, anchor)`` inner products: table entries added over groups, planes shifted in from the top."""
    rows, bits, groups = planes.shape
    total = np.zeros((rows, tables.shape[2]), tables.dtype)
    for bit in range(bits - 1, -1, -1):
        if bit < bits - 1:
            total += total
        for group in range(groups):
            part = tables[group].take(planes[:, bit, group], axis=0)
            # The top plane carries the sign.
            if bit == bits - 1:
                total -= part
            else:
                total += part
    return total


def exact_type(width: int, anchor_most: int, bits: int):
    """The smallest type in which no sum of a product can overflow."""
    bound = max(width, 1) * max(anchor_most, 1) << bits
    return np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object


@dataclass
class Candidates:
    """Candidates of one length, by rising id."""

    ids: np.ndarray
    labels: np.ndarray
    planes: list[np.ndarray]
    bits: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, int, bytes]], width: int) -> Candidates:
        groups = max(-(-width // GROUP), 1)
        rows.sort(key=lambda r: r[0])
        bits = np.array([len(r[2]) // groups for r in rows], np.int64)
        ids, labels = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        planes = []
        for start in range(0, len(rows), CHUNK):
            part, most = rows[start : start + CHUNK], int(bits[start : start + CHUNK].max())
            body = np.zeros((len(part), most, groups), np.uint8)
            for k, (_, _, packed) in enumerate(part):
                own = np.frombuffer(packed, np.uint8).reshape(-1, groups)
                body[k, : len(own)] = own
                # Further planes repeat the sign.
                body[k, len(own) :] = own[-1]
            planes.append(body)
        return cls(ids, labels, planes, bits)

    def taken(self, at: np.ndarray) -> Candidates:
        """The candidates at rising positions ``at``."""
        rows = [self.planes[k // CHUNK][k % CHUNK] for k in at.tolist()]
        planes = []
        for start in range(0, len(rows), CHUNK):
            part = rows[start : start + CHUNK]
            most = max(len(p) for p in part)
            planes.append(np.stack([np.concatenate([p, np.repeat(p[-1:], most - len(p), axis=0)]) for p in part]))
        return Candidates(self.ids[at], self.labels[at], planes, self.bits[at])

    def scored(self, anchors: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Chunks of candidates with their scores, ``(anchor, row)``."""
        most = int(np.abs(anchors).max(initial=0))
        made: dict = {}
        for k, planes in enumerate(self.planes):
            kind = exact_type(anchors.shape[1], most, planes.shape[1])
            if kind not in made:
                made[kind] = subset_tables(anchors, kind)
            yield slice(k * CHUNK, k * CHUNK + len(planes)), np.ascontiguousarray(products(made[kind], planes).T)


@dataclass
class Best:
    """The best ``most`` of a stream of scores between two bounds that comes by rising id."""

    most: int
    low: int | None = None
    high: int | None = None
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def full(self) -> bool:
        return len(self.ids) >= self.most

    def floor(self) -> int | None:
        """Scores below this cannot enter; on a tie the earlier, smaller id stays."""
        return int(self.scores[-1]) + 1 if self.full else self.low

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = self.floor()
        fits = np.ones(len(ids), bool)
        if floor is not None:
            fits &= scores >= floor
        if self.high is not None:
            fits &= scores <= self.high
        if not fits.any():
            return
        ids = np.concatenate([self.ids, ids[fits]])
        scores = np.concatenate([self.scores, scores[fits]])
        # Stable: equal scores stay in order of their ids.
        order = np.argsort(-scores, kind="stable")[: self.most]
        self.ids, self.scores = ids[order], scores[order]


@dataclass(frozen=True)
class Mining:
    """What is sought: positives and negatives for each, and the band in percent of the positive's score."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90

    def band(self, score: int) -> tuple[int, int]:
        return -(-self.low * score // 100), self.high * score // 100


_ROW = "dest int, kind int, key long, vec_id long, label long, width int, body binary, wanted array<long>"
_FOUND = "key long, wanted long, vec_id long, score long"
_FOUND_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")])


def _mined(anchors: list[tuple], found: Candidates, by_label: dict, rule: Mining) -> Iterator[tuple[int, int | None, Best]]:
    """For anchors of one label: their best positives, or for wanted scores the best negatives."""
    label = anchors[0][2]
    matrix = np.stack([np.frombuffer(a[3], np.int64) for a in anchors])
    if anchors[0][4] is None:
        if label not in by_label:
            by_label[label] = found.taken(np.flatnonzero(found.labels == label))
        partners = by_label[label]
        best = [[(None, Best(rule.positives))] for _ in anchors]
    else:
        partners = found
        best = [[(w, Best(rule.negatives, *rule.band(w))) for w in a[4]] for a in anchors]
    for rows, scores in partners.scored(matrix):
        ids = partners.ids[rows]
        other = partners.labels[rows] != label if partners is found else np.ones(len(ids), bool)
        for (_, own, *_), mine, line in zip(anchors, best, scores):
            floors = [b.floor() for _, b in mine]
            at = other & (ids != own)
            if None not in floors:
                at &= line >= min(floors)
            highs = [b.high for _, b in mine]
            if None not in highs:
                at &= line <= max(highs)
            if at.any():
                near, line = ids[at], line[at]
                for _, b in mine:
                    b.add(near, line)
    for (key, *_), mine in zip(anchors, best):
        for wanted, b in mine:
            yield key, wanted, b


def _search(rows: DataFrame, rule: Mining) -> DataFrame:
    """``_FOUND`` of every task over rows that are sorted by task, candidates before anchors, anchors by label."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dest, held, sorted_, by_label, waiting = None, {}, {}, {}, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not waiting:
                return
            width = waiting[0][5]
            if width not in sorted_ and width in held:
                sorted_[width], by_label[width] = Candidates.of(held.pop(width), width), {}
            if width in sorted_:
                for label in list(by_label[width]):
                    # Anchors come by label: those of the last one are not needed again.
                    if label != waiting[0][2]:
                        del by_label[width][label]
                out = []
                for key, wanted, best in _mined(waiting, sorted_[width], by_label[width], rule):
                    out += [
                        (key, wanted, i, min(max(int(s), -LONG - 1), LONG))
                        for i, s in zip(best.ids.tolist(), best.scores.tolist())
                    ]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out)], schema=_FOUND_ARROW
                    )
            waiting.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                here, kind, key, vec_id, label, width, body, wanted = row
                if here != dest:
                    yield from flush()
                    dest, held, sorted_, by_label = here, {}, {}, {}
                if not kind:
                    held.setdefault(width, []).append((vec_id, label, body))
                    continue
                if waiting and (len(waiting) >= ANCHORS or (waiting[0][2], waiting[0][5]) != (label, width)):
                    yield from flush()
                waiting.append((key, vec_id, label, body, wanted, width))
        yield from flush()

    return rows.mapInArrow(run, _FOUND)


def _packed(rows: DataFrame, is_anchor: Column, scale: float, tasks: int) -> DataFrame:
    """Usable rows as ``vec_id, label, width, planes``, the integers of anchors, a row number and a task."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (
        rows.select(
            rows["vec_id"].cast("long").alias("vec_id"),
            rows["label"].cast("long").alias("label"),
            rows["embedding"].cast("array<double>").alias("v"),
            is_anchor.alias("anchor"),
        )
        .filter("vec_id is not null and label is not null and v is not null")
        .filter(finite)
    )
    schema = pa.schema(
        [("vec_id", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("planes", pa.binary()), ("integers", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            planes, exact = [b""] * len(sizes), [None] * len(sizes)
            wanted = batch.column(3).to_pylist()
            flat = vectors.flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for width in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == width)
                values = integers(flat[starts[at][:, None] + np.arange(width)], scale)
                bits = widths(values)
                for b in np.unique(bits).tolist():
                    inside = bits == b
                    for k, p in zip(at[inside].tolist(), bit_planes(values[inside], b)):
                        # An empty vector has one byte, of no component.
                        planes[k] = p.tobytes() or bytes(1)
                for k, v in zip(at.tolist(), values):
                    if wanted[k]:
                        exact[k] = v.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(planes, pa.binary()), pa.array(exact, pa.binary())],
                schema=schema,
            )

    packed = usable.mapInArrow(run, "vec_id long, label long, width int, planes binary, integers binary")
    # Numbered once and stored, so that a task that is repeated finds the same numbers.
    numbered = packed.withColumn("key", F.monotonically_increasing_id())
    return durable(numbered.withColumn("dest", F.pmod("key", F.lit(tasks)).cast("int")), "bit-planes")


def _met(packed: DataFrame, anchors: DataFrame, tasks: int) -> DataFrame:
    """Candidates at their task and all anchors at each, in the order ``_search`` asks for."""
    none = F.lit(None).cast("array<long>")
    candidates = packed.select(
        "dest", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), "vec_id", "label", "width",
        F.col("planes").alias("body"), none.alias("wanted"),
    )
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("dest")
    sent = anchors.select(everywhere, F.lit(1).alias("kind"), "key", "vec_id", "label", "width", F.col("integers").alias("body"), "wanted")
    rows = candidates.unionAll(sent)
    return rows.repartitionById(tasks, F.col("dest")).sortWithinPartitions(
        "dest", "kind", F.when(F.col("kind") == 1, F.col("width")), F.when(F.col("kind") == 1, F.col("label")), "vec_id"
    )


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def tasks_for(rows: DataFrame) -> int:
    """Tasks that candidates are dealt over: enough for the memory of each, and for the cores there are."""
    count = rows.count()
    cores = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return max(-(-count // MOST_IN_TASK), min(cores, -(-count // LEAST_IN_TASK)), 1)


def mine(rows: DataFrame, is_anchor: Column, rule: Mining = Mining(), scale: float = 256.0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` holds ``vec_id, embedding, label``; ``is_anchor`` picks the query set among them.
    """
    tasks = tasks_for(rows)
    packed = _packed(rows, F.coalesce(is_anchor, F.lit(False)), scale, tasks)
    anchors = packed.filter("integers is not null").select("key", "vec_id", "label", "width", "integers")
    first = _search(_met(packed, anchors.withColumn("wanted", F.lit(None).cast("array<long>")), tasks), rule)
    # A few rows of each task for an anchor.
    positives = durable(
        _ranked(first, ["key"], rule.positives).select(
            "key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    wanted = positives.groupBy("key").agg(F.collect_set("positive_score").alias("wanted"))
    second = _search(_met(packed, anchors.join(wanted, "key"), tasks), rule)
    negatives = _ranked(second, ["key", "wanted"], rule.negatives).select(
        "key", F.col("wanted").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = positives.join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return named.join(negatives, ["key", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def sql(rule: Mining = Mining()) -> str:
    """The registered query in SQL, every anchor against every row."""
    return f"""with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
a as (select row_number() over () as k, * from v where vec_id % 100 = 0),
s as (
  select k, a.vec_id as anchor_id, v.vec_id as other, a.label = v.label as same,
    cast(list_inner_product(a.q, v.q) as bigint) as score
  from a join v on a.vec_id <> v.vec_id and len(a.q) = len(v.q)
),
p as (
  select * from (select *, row_number() over (partition by k order by score desc, other) as place from s where same)
  where place <= {rule.positives}
),
n as (
  select p.anchor_id, p.other as positive_id, s.other as negative_id, p.score as positive_score, s.score as negative_score,
    cast(row_number() over (partition by p.k, p.place order by s.score desc, s.other) as int) as rank
  from p join s using (k)
  where not s.same and {rule.low} * p.score <= 100 * s.score and 100 * s.score <= {rule.high} * p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {rule.negatives}"""
