"""Centroid clustering over zone maps along a space-filling curve.

Vectors are whole numbers.  They are ordered along the Hilbert curve of their
quantised components, cut into blocks and stored with the least and the
greatest value of each component: the block's box.  No vector of a block lies
nearer to a centroid than the box does, and none farther than the box's
farthest corner.  So a centroid whose least distance to the box is above the
smallest greatest distance of any centroid is nobody's nearest; the others are
the block's candidates and are compared exactly.  A block with one candidate
gives its stored sum at once.

All arithmetic is exact: in doubles while every intermediate value is a whole
number below 2^53, in 64 bits while it fits, else in Python's integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaysight.llm.common import stored

# Rows of a block, bits of a component on the curve.
BLOCK = 1024
BITS = 4
# Largest components for which squared distances over WIDTH dimensions are
# exact in doubles (2^52) and in 64 bits (2^62).
WIDTH = 64
EXACT_DOUBLE = 1 << 22
EXACT_LONG = 1 << 27
# Parts in which the sums of one centroid are added up.
SALTS = 32


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (a row of coordinates below 2^bits) on the Hilbert
    curve, as big-endian bytes: the coordinates' bits after undoing, from the
    largest cube to the smallest, the turns of the curve, in Gray code."""
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    for level in range(bits - 1, 0, -1):
        side, inside = 1 << level, (1 << level) - 1
        for axis in x:
            far = (axis & side) != 0
            swap = np.where(far, 0, (x[0] ^ axis) & inside)
            x[0] ^= np.where(far, inside, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    return math.floor(x * scale) if abs(x) < 2.0 ** 52 else int(x) * scale


def _packed(rows: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled rows of those that fit EXACT_LONG, and which fit."""
    with np.errstate(over="ignore"):
        y = np.floor(rows * float(scale))
        fit = (np.abs(y) <= EXACT_LONG).all(axis=1)
    return y[fit].astype(np.int32), fit


def _digits(values) -> str:
    return ",".join(map(str, values))


def _numbers(digits: str) -> list[int]:
    return list(map(int, digits.split(",")))


def finite(vector: Column, width: int) -> Column:
    """Whether a vector has exactly ``width`` components, none null, NaN or infinite."""
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == width) & ok, F.lit(False))


_CURVE = "vec_id long, place binary, salt long, x binary, digits string"
_BLOCKS = "n int, ids array<long>, x binary, digits array<string>"


def _on_curve(low: np.ndarray, high: np.ndarray, scale: int):
    """Rows (id, vector) -> rows with their place on the curve.  A row holds
    its scaled components as 32-bit numbers or, if one doesn't fit, in digits."""
    step = np.where(high > low, (high - low) / (1 << BITS), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 36
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(batch.num_rows, -1)
            with np.errstate(over="ignore"):
                cells = np.clip(np.floor((rows - low) / step), 0, (1 << BITS) - 1).astype(np.int64)
            places = hilbert_keys(cells, BITS)
            small, fit = _packed(rows, scale)
            packed = iter(small)
            # rows of equal place are dealt by a mixed running number
            salts = (np.arange(made, made + len(rows), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            made += len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p.tobytes() for p in places], pa.binary()), pa.array(salts),
                 pa.array([next(packed).tobytes() if f else None for f in fit], pa.binary()),
                 pa.array([None if f else _digits(_whole(c, scale) for c in r.tolist()) for f, r in zip(fit, rows, strict=True)], pa.string())],
                names=["vec_id", "place", "salt", "x", "digits"])
    return run


def _into_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows -> blocks; rows in digits go into blocks of their own."""
    waiting: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}

    def block(wide: bool) -> pa.RecordBatch:
        ids, rows = waiting[wide]
        waiting[wide] = ([], [])
        return pa.RecordBatch.from_arrays(
            [pa.array([len(ids)], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([None if wide else b"".join(rows)], pa.binary()),
             pa.array([rows if wide else None], pa.list_(pa.string()))], names=["n", "ids", "x", "digits"])

    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("vec_id", "x", "digits"))
        for i, x, digits in zip(*columns, strict=True):
            wide = x is None
            ids, rows = waiting[wide]
            ids.append(i)
            rows.append(digits if wide else x)
            if len(ids) == BLOCK:
                yield block(wide)
    for wide, (ids, _) in list(waiting.items()):
        if ids:
            yield block(wide)


def _with_box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> blocks with their box and sum, in digits."""
    for batch in batches:
        for r in batch.to_pylist():
            x = _matrix(r)
            low, high, total = x.min(axis=0), x.max(axis=0), x.sum(axis=0, dtype=object if x.dtype == object else np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((r["n"], pa.int32()), (r["ids"], pa.list_(pa.int64())), (r["x"], pa.binary()),
                                               (r["digits"], pa.list_(pa.string())), (_digits(low.tolist()), pa.string()),
                                               (_digits(high.tolist()), pa.string()), (_digits(total.tolist()), pa.string()))],
                names=["n", "ids", "x", "digits", "low", "high", "total"])


def _matrix(block: dict) -> np.ndarray:
    if block["x"] is None:
        return np.array([_numbers(d) for d in block["digits"]], object)
    return np.frombuffer(block["x"], np.int32).reshape(block["n"], -1)


def _kind(most: int):
    return np.float64 if most <= EXACT_DOUBLE else np.int64 if most <= EXACT_LONG else object


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector of the box, ascending."""
    nearest = (np.maximum(np.maximum(low - centroids, centroids - high), 0) ** 2).sum(axis=1)
    farthest = (np.maximum(abs(centroids - low), abs(centroids - high)) ** 2).sum(axis=1)
    return np.flatnonzero((nearest <= farthest.min()).astype(bool))


class _Assigner:
    """Assigns the vectors of blocks to their nearest centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.most = max((abs(c) for row in centroids for c in row), default=0)
        self.exact = np.array(centroids, object)
        self.cast: dict = {}

    def __call__(self, block: dict, distances: bool) -> tuple[np.ndarray | int, np.ndarray | None]:
        """Number of each vector's nearest centroid, ties to the smaller, and
        the squared distance; one number for all if the box leaves one and no
        distances are asked for."""
        low, high = _numbers(block["low"]), _numbers(block["high"])
        kind = _kind(max(self.most, *map(abs, low), *map(abs, high)))
        if kind not in self.cast:
            self.cast[kind] = self.exact.astype(kind)
        centroids = self.cast[kind]
        can = candidates(np.array(low, kind), np.array(high, kind), centroids)
        if len(can) == 1 and not distances:
            return int(can[0]), None
        x, c = _matrix(block).astype(kind), centroids[can]
        squared = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]
        best = squared.argmin(axis=1)
        return can[best], squared[np.arange(len(x)), best]


_SUMS = "cluster int, salt int, n long, total string, inertia string"


def _sums(assign: _Assigner, distances: bool):
    """Blocks -> count, sum and inertia of each centroid's vectors in the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, list] = {}

        def add(cluster: int, n: int, total, inertia: int) -> None:
            if cluster not in found:
                found[cluster] = [0, np.zeros(len(total), object), 0]
            at = found[cluster]
            at[0] += n
            at[1] = at[1] + np.array(total, object)
            at[2] += inertia

        for batch in batches:
            for r in batch.to_pylist():
                near, far = assign(r, distances)
                if isinstance(near, int):
                    add(near, r["n"], _numbers(r["total"]), 0)
                    continue
                x = _matrix(r)
                for cluster in np.unique(near).tolist():
                    own = near == cluster
                    total = x[own].sum(axis=0, dtype=object if x.dtype == object else np.int64).tolist()
                    add(cluster, int(own.sum()), total, sum(map(int, far[own].tolist())) if distances else 0)
        salt = TaskContext.get().partitionId() % SALTS
        yield _sum_rows(salt, found)
    return run


def _sum_rows(salt: int, found: dict[int, list]) -> pa.RecordBatch:
    rows = [(c, salt, n, _digits(total.tolist()), str(inertia)) for c, (n, total, inertia) in sorted(found.items())]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                      names=["cluster", "salt", "n", "total", "inertia"])


def _add_up(table: pa.Table) -> pa.Table:
    """Sums of one centroid and salt -> one row."""
    rows = table.to_pylist()
    total = sum(np.array(_numbers(r["total"]), object) for r in rows)
    found = {rows[0]["cluster"]: [sum(r["n"] for r in rows), total, sum(int(r["inertia"]) for r in rows)]}
    return pa.Table.from_batches([_sum_rows(rows[0]["salt"], found)])


def _measure(blocks: DataFrame, centroids: list[list[int]], distances: bool) -> dict[int, tuple[int, list[int], int]]:
    """Count, sum and inertia of each centroid that has vectors.  At most
    SALTS rows for each centroid come to the driver."""
    parts = blocks.mapInArrow(_sums(_Assigner(centroids), distances), _SUMS)
    found: dict[int, tuple[int, list[int], int]] = {}
    for r in parts.groupBy("cluster", "salt").applyInArrow(_add_up, _SUMS).collect():
        n, total, inertia = found.get(r.cluster, (0, [0] * len(centroids[0]), 0))
        found[r.cluster] = (n + r.n, [a + b for a, b in zip(total, _numbers(r.total), strict=True)], inertia + int(r.inertia))
    return found


def _place(blocks: DataFrame, assign: _Assigner) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                near, far = assign(r, True)
                far = list(map(int, far.tolist()))
                long = [d < 1 << 63 for d in far]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], pa.int64()), pa.array(near.astype(np.int32)),
                     pa.array([d if f else None for d, f in zip(far, long, strict=True)], pa.int64()),
                     pa.array([None if f else str(d) for d, f in zip(far, long, strict=True)], pa.string())],
                    names=["vec_id", "cluster", "distance", "wide_distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long, wide_distance string")


def blocks_on_curve(vectors: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """The kept vectors in blocks along the Hilbert curve, with boxes, stored."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        finite(F.col("v"), width))
    # the curve covers two standard deviations around the mean of each component;
    # values beyond lie in its outermost cells
    limited = [F.greatest(F.lit(-1e100), F.least(F.lit(1e100), F.col("v")[i])) for i in range(width)]
    spread = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(limited) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([spread[f"m{i}"] or 0.0 for i in range(width)])
    wide = np.nan_to_num(np.array([spread[f"s{i}"] or 0.0 for i in range(width)])) * 2
    placed = rows.mapInArrow(_on_curve(mean - wide, mean + wide, scale), _CURVE)
    ordered = placed.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt")
    return stored(ordered.mapInArrow(_into_blocks, _BLOCKS).mapInArrow(
        _with_box, _BLOCKS + ", low string, high string, total string"), "curve-blocks")


def first_centroids(vectors: DataFrame, id_col: str, vector_col: str, k: int, width: int, scale: int, salt: str) -> list[list[int]]:
    """The k kept vectors with the smallest sha256 of salt and id, ascending."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        finite(F.col("v"), width) & F.col("vec_id").isNotNull())
    chosen = rows.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), "v").limit(k).collect()
    return [[_whole(c, scale) for c in r.v] for r in chosen]


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = WIDTH, scale: int = 256, salt: str = "2:",
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256,
    wide_distance, wide_cluster_inertia, wide_inertia)``: one row per kept vector.

    Kept are vectors of ``width`` components without nulls, NaN and infinity;
    their components become floor(scale * x).  The first centroids are the k
    kept vectors whose id has the smallest hash (fewer vectors: fewer
    centroids; rows that repeat an id in ascending order of their vectors).
    Each round assigns every vector to its nearest centroid, ties to the
    smaller number, and moves each centroid to the floored mean of its
    vectors; one without vectors stays.  Then all are assigned once more.

    A vector without id is clustered but is never a first centroid; repeated
    rows count as often as they stand; no kept vectors: no rows, and so with
    kept vectors none of which has an id.  Other columns are ignored.  A number
    beyond 64 bits is null and stands in its ``wide_`` column as digits, which
    is null otherwise.  ``k`` is meant to be small: the centroids travel with
    every task.  The table is shuffled once, each round reads the stored blocks.
    """
    if not 0 < width <= WIDTH:
        raise ValueError(f"width must be from 1 to {WIDTH}")   # beyond it, the exact ranges would be smaller
    centroids = first_centroids(vectors, id_col, vector_col, k, width, scale, salt)
    spark = vectors.sparkSession
    out = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, "
           "wide_distance string, wide_cluster_inertia string, wide_inertia string")
    if not centroids:
        return spark.createDataFrame([], out)
    blocks = blocks_on_curve(vectors, id_col, vector_col, width, scale)
    for _ in range(rounds):
        for number, (n, total, _) in _measure(blocks, centroids, False).items():
            centroids[number] = [t // n for t in total]
    inertia = {number: found[2] for number, found in _measure(blocks, centroids, True).items()}
    whole = sum(inertia.values())

    def fitting(value: int) -> tuple[int | None, str | None]:
        return (value, None) if value < 1 << 63 else (None, str(value))

    rows = [(number, *fitting(own), *fitting(whole), hashlib.sha256(_digits(centroids[number]).encode()).hexdigest())
            for number, own in inertia.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, wide_cluster_inertia string, inertia long, "
                                        "wide_inertia string, centroid_sha256 string")
    names = [part.strip().split(" ")[0] for part in out.split(",")]
    return _place(blocks, _Assigner(centroids)).join(F.broadcast(facts), "cluster").select(*names)   # at most k facts
