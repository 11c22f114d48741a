"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are whole numbers.  The index cuts the rows into blocks; in a block the
postings of each dimension are sorted by quantised impact, the size of the
component in steps of STEP.  All dimensions' segments of the highest impact are
processed first, for a chunk of queries at once, then the next.  What is not
yet processed can change a score by at most ``rest = sum |q_d| * u_d`` with
``u_d`` the largest component left, so a row can still be among the k best
only if its partial score reaches the k-th best partial score less
``2 * rest``.  A query stops when that proof leaves few rows; those are scored
exactly.  Without such proof all segments are processed.

Pairs with a component over LARGEST are all scored, in 64 bits where the product
provably fits and in Python's integers elsewhere, and join the same ranking.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaysight.llm.common import stored

# Steps of a quantised impact, rows of an index block, queries scored together.
STEP = 32
BLOCK = 8192
CHUNK = 128
# A query stops when at most this many rows can still be members.
FEW = 256
# Vectors with a larger component than this are scored pair by pair in exact
# integers, without the index: there, 64 bits and doubles would not do.
LARGEST = 1 << 22


def scaled(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, a whole number as double; null if
    the vector is null or has a null or non-finite component.  A finite
    component for which scale * x is beyond a double is an error."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))

    def floor(y: Column) -> Column:
        # from 2^53 on every double is whole
        return (F.when(F.abs(y) < F.lit(2.0 ** 53), F.floor(y).cast("double"))
                .when(F.abs(y) == F.lit(float("inf")), F.raise_error(F.lit("scale * x is beyond a double")).cast("double"))
                .otherwise(y))

    return F.when(vector.isNotNull() & F.coalesce(finite, F.lit(False)), F.transform(x, lambda v: floor(v * scale)))


def _is_wide(vector: str, scale: int = 1) -> Column:
    # two comparisons: abs of the smallest long overflows
    return F.exists(vector, lambda v: (v > LARGEST // scale) | (v < -LARGEST // scale))


def _finite(vector: str) -> Column:
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly, whatever the size of x."""
    return int(x) * scale if isinstance(x, int) or abs(x) >= 2.0 ** 53 else math.floor(x * scale)


def _packed(rows: list[list[int]]) -> tuple[np.ndarray, int]:
    width = max([0, *map(len, rows)])
    out = np.zeros((len(rows), width), np.int32)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out, width


def _blocks(size: int):
    """Rows (id, vector) -> blocks of at most ``size`` rows of one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        rows: list[list[int]] = []

        def block() -> pa.RecordBatch:
            nonlocal made, ids, rows
            x, width = _packed(rows)
            # postings of a dimension: rows by falling impact
            impact = np.abs(x) // STEP
            order = np.argsort(-impact, axis=0, kind="stable").astype(np.int32)
            made += 1
            out = pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made], pa.int64()), pa.array([width], pa.int32()),
                 pa.array([np.array(ids, np.int64).tobytes()]), pa.array([x.tobytes()]),
                 pa.array([np.ascontiguousarray(order.T).tobytes()])], names=["block", "width", "ids", "x", "postings"])
            ids, rows = [], []
            return out

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield block()
        if ids:
            yield block()
    return run


_BLOCK_SCHEMA = "block long, width int, ids binary, x binary, postings binary"


def index(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The index of the vectors without a component over LARGEST, stored: one
    row per block."""
    rows = vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).where(
        F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~_is_wide(vector_col))
    return stored(rows.mapInArrow(_blocks(BLOCK), _BLOCK_SCHEMA), "impact-index")


def search_block(queries: np.ndarray, x: np.ndarray, postings: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the rows of ``x`` that can be among its k best; found
    score at a time, a superset of the k best with all ties."""
    n, width = x.shape
    level = np.abs(x) // STEP
    held = np.stack([level[postings[d], d] for d in range(width)]) if width else np.empty((0, n), np.int32)
    done = np.zeros(width, np.int64)
    left = np.arange(len(queries))
    out: list[np.ndarray] = [np.arange(n)] * len(queries)
    if n <= k or not width:
        return out
    q = queries.astype(np.float64)
    acc = np.zeros((n, len(queries)))
    size = np.abs(q)
    for top in range(int(held.max(initial=0)), -1, -1):
        for d in range(width):
            end = int(np.searchsorted(-held[d], -top, side="right"))
            if end > done[d]:
                rows = postings[d, done[d]:end]
                acc[rows] += x[rows, d, None] * q[None, left, d]
                done[d] = end
        if top and top % 2:
            continue   # the proof is tried after every second level
        most = np.where(done < n, top * STEP - 1, 0)   # all that is left lies below this level
        rest = size[left] @ np.maximum(most, 0)
        kth = np.partition(acc, n - k, axis=0)[n - k]
        may = acc >= kth - 2 * rest - 1 - 1e-12 * np.abs(kth)   # room for rounding
        ready = (may.sum(axis=0) <= FEW) | (top == 0)
        for i in np.flatnonzero(ready):
            out[left[i]] = np.flatnonzero(may[:, i])
        if ready.any():
            left, acc = left[~ready], np.ascontiguousarray(acc[:, ~ready])
        if not len(left):
            break
    return out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def array(value: bytes, kind, width: int) -> np.ndarray:
            flat = np.frombuffer(value, kind)
            return flat.reshape(-1, width) if width else flat

        for batch in batches:
            for r in batch.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                wide = max(r["width"], r["q_width"])
                x, q = (np.zeros((len(i), wide), np.int64) for i in (ids, q_ids))
                if r["width"]:
                    x[:, :r["width"]] = array(r["x"], np.int32, r["width"])
                if r["q_width"]:
                    q[:, :r["q_width"]] = array(r["q_x"], np.int32, r["q_width"])
                postings = array(r["postings"], np.int32, len(ids)).reshape(r["width"], len(ids))
                if wide > r["width"]:   # the queries' further dimensions hold no postings
                    postings = np.concatenate((postings, np.tile(np.arange(len(ids), dtype=np.int32), (wide - r["width"], 1))))
                found = []
                for at in range(0, len(q), CHUNK):
                    # one more than k: the query's own row may be among them
                    own = int(np.isin(ids, q_ids).sum() and np.unique(ids, return_counts=True)[1].max())
                    for i, rows in enumerate(search_block(q[at:at + CHUNK], x, postings, k + own), at):
                        rows = rows[ids[rows] != q_ids[i]]
                        score = x[rows] @ q[i]
                        best = np.lexsort((ids[rows], -score))[:k]
                        found.append(np.column_stack((np.full(len(best), q_ids[i]), ids[rows][best], score[best])))
                hit = np.concatenate(found) if found else np.empty((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hit[:, j]) for j in range(3)], names=["query_id", "vec_id", "score"])
    return run


def _pickled(size: int, scale: int):
    """Rows (id, vector) -> blocks of at most ``size`` rows of one task, scaled,
    in Python's integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows = [[_whole(x, scale) for x in v] for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((part.column(0).to_pylist(), rows))], pa.binary())],
                                                 names=["rows"])
    return run


def _matrix(rows: list[list[int]], width: int, kind) -> np.ndarray:
    out = np.zeros((len(rows), width), kind)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _score_pairs(k: int):
    """Blocks of rows and of queries -> for each query the k best of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (ids, x), (q_ids, q) = pickle.loads(r["rows"]), pickle.loads(r["q_rows"])
                width = max(map(len, x + q))
                most = [max((abs(c) for v in rows for c in v), default=0) for rows in (x, q)]
                fits = max(1, width) * max(1, most[0]) * max(1, most[1]) < 1 << 63
                kind = np.int64 if fits else object
                scores = _matrix(q, width, kind) @ _matrix(x, width, kind).T if width else np.zeros((len(q), len(x)), kind)
                out = [(q_id, i, -s) for q_id, row in zip(q_ids, scores.tolist(), strict=True)
                       for s, i in heapq.nsmallest(k, ((-s, i) for s, i in zip(row, ids, strict=True) if i != q_id))]
                long = [-(1 << 63) <= s < 1 << 63 for *_, s in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                     pa.array([o[2] if f else None for o, f in zip(out, long, strict=True)], pa.int64()),
                     pa.array([None if f else str(o[2]) for o, f in zip(out, long, strict=True)], pa.string())],
                    names=["query_id", "vec_id", "score", "wide_score"])
    return run


def _wide_hits(rows: DataFrame, asked: DataFrame, k: int, scale: int) -> DataFrame | None:
    """The best pairs of which at least one vector has a component over
    LARGEST; None without such a vector."""
    wide = stored(rows.where(_is_wide("v", scale)), "wide-vectors")
    if wide.isEmpty():
        return None

    def met(candidates: DataFrame, queries: DataFrame) -> DataFrame:
        q = queries.mapInArrow(_pickled(CHUNK, scale), "rows binary").withColumnRenamed("rows", "q_rows")
        return candidates.mapInArrow(_pickled(BLOCK, scale), "rows binary").crossJoin(q).mapInArrow(
            _score_pairs(k), "query_id long, vec_id long, score long, wide_score string")

    asked = stored(asked, "asked")
    return met(wide, asked).unionByName(met(rows.where(~_is_wide("v", scale)), asked.where(_is_wide("v", scale))))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score, wide_score)``: for every row with
    ``is_query`` the k highest inner products with the other rows, ties to the
    smaller id.  A score beyond 64 bits is null in ``score`` and stands in
    ``wide_score`` as its decimal digits, which is null otherwise.

    ``vector_col`` holds arrays of whole numbers, long or double; with
    ``scale`` it holds any numbers, of which floor(scale * x) is taken, exactly
    for every finite double, and vectors with a null or non-finite component
    take no part.  Rows with a null id or vector take no
    part; shorter vectors count as filled up with zeros.  Rows that repeat an
    id are candidates each, but never of a query with that id; of a repeated
    query id the smallest vector asks.  Without queries or candidates there are
    no rows; other columns are ignored.  Queries are met with the index block
    by block.
    """
    vector = F.col(vector_col) if scale is None else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), is_query.alias("asks")).where(
        "id IS NOT NULL AND v IS NOT NULL")
    if scale is not None:
        rows = rows.where(_finite("v"))
    by = scale or 1

    def small(part: DataFrame) -> DataFrame:
        part = part.where(~_is_wide("v", by))
        return part if scale is None else part.withColumn("v", scaled(F.col("v"), scale))

    blocks = index(small(rows), "id", "v")
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    wide = _wide_hits(rows.select("id", "v"), asked, k, by)
    queries = stored(small(asked).mapInArrow(_blocks(4 * CHUNK), _BLOCK_SCHEMA).select(
        F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x")), "query-blocks")
    places = blocks.select("block").withColumn("place", F.row_number().over(Window.orderBy("block")) - 1)   # a row per block
    number = blocks.count()
    spread = queries.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(max(0, number - 1)))))
    met = spread.join(places, "place").join(blocks, "block").select(
        "q_width", "q_ids", "q_x", "width", "ids", "x", "postings")
    hits = met.mapInArrow(_search(k), "query_id long, vec_id long, score long").withColumn(
        "wide_score", F.lit(None).cast("string"))
    if wide is not None:
        hits = hits.unionByName(wide)
    # wide scores by sign and length, then by digit
    negative = F.startswith("wide_score", F.lit("-"))
    length = F.coalesce(F.length("wide_score") * F.when(negative, F.lit(-1)).otherwise(1), F.lit(0))
    digits = F.when(negative, F.translate("wide_score", "0123456789", "9876543210")).otherwise(F.col("wide_score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(length.desc(), F.desc("score"), digits.desc(), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score", "wide_score")
