"""Ranked lexical search over buckets of document vectors of like length.

A document is a vector with one whole component for each term of the queries
that it holds: the term's weight times its saturated frequency.  A query is the
set of its terms, so a score is the sum of the document's components over that
set.  Documents are ordered by the length of their vectors, longest first, and
cut into buckets.  For a query of q terms

* no score of a bucket exceeds sqrt(q) times its greatest length
  (Cauchy-Schwarz): a bucket below the query's k-th best score is passed over;
* inside a bucket the query's terms are read from the heaviest on, until what
  the bucket's greatest components of the others add up to, u, is less than
  the k-th best score; with the sum a of the components read and the length
  that the vector keeps without them, no score exceeds
  a + min(u, sqrt(terms left) * rest): documents below the k-th best score are
  left out;
* the survivors are scored anew in 64-bit integers.

The longest buckets are searched first, all at once; their k-th best scores are
the thresholds with which the others are searched, and each task raises its own.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaysight.llm.common import drop_stored, stored

# Documents of a bucket, terms of a query that are read at least, and the share
# of buckets that set the thresholds.
BUCKET = 1024
FOCUS = 4
LEADING = 0.04
# Terms of the queries that are searched in one pass over the documents; more
# queries take more passes.
TERMS = 1 << 19
# Room for rounding in bounds, which are doubles.
SLACK = 1e-9

# Bytes of terms: digits, letters (A-Z lower-cased) and all beyond ASCII.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def damping(n: int, documents: int, words: int) -> int:
    """A document's m: 10 plus 90 times its length over the mean length."""
    return 100 - 90 + (90 * n * documents) // words


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [sorted(set(terms_of(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.binary()))], names=["item_id", "terms"])


_VECTORS = "doc_id long, n long, terms binary, counts binary"


def _vectors(numbers: dict[bytes, int]):
    """Documents -> their length in terms and the counts of the queries' terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = terms_of(text.as_py())
                if terms:
                    found = [(numbers[t], c) for t, c in Counter(terms).items() if t in numbers]
                    pairs = np.array(found, np.int64).reshape(-1, 2)
                    pairs = pairs[np.argsort(pairs[:, 0])]
                    values = (i, len(terms), pairs[:, 0].astype(np.int32).tobytes(), pairs[:, 1].astype(np.int32).tobytes())
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                                             names=["doc_id", "n", "terms", "counts"])
    return run


def _holding(size: int):
    """Vectors -> number of the task's documents that hold each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            numbers = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            held += np.bincount(numbers, minlength=size)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(held[found])], names=["term", "holding"])
    return run


_IMPACTS = "doc_id long, norm double, salt long, terms binary, impacts binary"


def _impacts(weights: np.ndarray, documents: int, words: int):
    """Vectors -> components and length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms, impacts, salts = [], [], []
            columns = {name: batch.column(batch.schema.get_field_index(name)) for name in ("n", "terms", "counts")}
            for n, terms, counts in zip(*(c.to_pylist() for c in columns.values()), strict=True):
                tf = np.frombuffer(counts, np.int32).astype(np.int64)
                number = np.frombuffer(terms, np.int32)
                x = weights[number] * ((1_000_000_000 * tf) // (1000 * tf + 8 * damping(n, documents, words)))
                y = x.astype(np.float64)
                norms.append(math.sqrt(float(y @ y)))
                impacts.append(x.tobytes())
                # copies of one document are dealt by a mixed running number
                salts.append((len(salts) * 0x9E3779B97F4A7C15) & ((1 << 63) - 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(norms, pa.float64()), pa.array(salts, pa.int64()),
                 columns["terms"], pa.array(impacts, pa.binary())], names=["doc_id", "norm", "salt", "terms", "impacts"])
    return run


_BUCKETS = "longest double, ids array<long>, norms binary, sizes binary, terms binary, impacts binary"


def _into_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[dict] = []

    def bucket() -> pa.RecordBatch:
        norms = np.array([r["norm"] for r in waiting])
        sizes = np.array([len(r["terms"]) // 4 for r in waiting], np.int32)
        values = (float(norms.max()), [r["doc_id"] for r in waiting], norms.tobytes(), sizes.tobytes(),
                  b"".join(r["terms"] for r in waiting), b"".join(r["impacts"] for r in waiting))
        kinds = (pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)],
                                          names=["longest", "ids", "norms", "sizes", "terms", "impacts"])

    for batch in batches:
        for r in batch.to_pylist():
            waiting.append(r)
            if len(waiting) == BUCKET:
                yield bucket()
    if waiting:
        yield bucket()


class Bucket:
    """A bucket's vectors, by document and by term."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.longest = row["longest"]
        self.squares = np.frombuffer(row["norms"], np.float64) ** 2
        self.ends = np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], np.int32), dtype=np.int64)))
        self.terms = np.frombuffer(row["terms"], np.int32)
        self.impacts = np.frombuffer(row["impacts"], np.int64)
        order = np.argsort(self.terms, kind="stable")
        self.rows = np.repeat(np.arange(len(self.ids)), np.diff(self.ends))[order]
        self.by_term = self.impacts[order].astype(np.float64)
        self.held, begin = np.unique(self.terms[order], return_index=True)
        self.begin = np.concatenate((begin, [len(order)]))
        self.greatest = np.maximum.reduceat(self.by_term, begin) if len(begin) else np.zeros(0)

    def survivors(self, query: np.ndarray, least: float) -> np.ndarray:
        """Documents that can score ``least`` or more and hold a term of the
        query, whose heaviest terms come first; a superset of those that do."""
        if math.sqrt(len(query)) * self.longest * (1 + SLACK) < least:
            return np.empty(0, np.int64)
        at = np.searchsorted(self.held, query)
        here = at < len(self.held)
        here[here] = self.held[at[here]] == query[here]
        at = at[here]   # of a term that the bucket lacks nothing comes
        left = np.concatenate((np.cumsum(self.greatest[at][::-1])[::-1], [0.0]))
        few = max(min(FOCUS, len(at)), int(np.searchsorted(-left, -least, "right")))
        few = min(few, len(at))
        score, taken = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for a, b in zip(self.begin[at[:few]].tolist(), self.begin[at[:few] + 1].tolist(), strict=True):
            rows, x = self.rows[a:b], self.by_term[a:b]   # a document holds a term once
            score[rows] += x
            taken[rows] += x * x
        # what rounding can leave of the squares is at most SLACK of them
        rest = np.sqrt(np.maximum(self.squares - taken, 0) + SLACK * self.squares)
        bound = (score + np.minimum(left[few], math.sqrt(len(at) - few) * rest)) * (1 + SLACK)
        return np.flatnonzero((bound >= least) & (bound > 0))

    def scores(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of the documents; ``asked`` marks the query's terms."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(begin[-1]) + np.repeat(self.ends[rows] - begin[:-1], sizes)
        sums = np.concatenate(([0], np.cumsum(np.where(asked[self.terms[at]], self.impacts[at], 0))))
        return sums[begin[1:]] - sums[begin[:-1]]


def _search(items: list[tuple[int | None, np.ndarray]], least: list[int], size: int, k: int):
    """Buckets -> for each query the task's k best documents of at least the
    query's threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (score, null ids last, smaller ids better); the worst of the k on top
        best: list[list[tuple[int, int, int]]] = [[] for _ in items]
        asked = np.zeros(size, bool)
        for batch in batches:
            for row in batch.to_pylist():
                bucket = Bucket(row)
                for number, (_, query) in enumerate(items):
                    heap = best[number]
                    bar = max(least[number], heap[0][0] if len(heap) == k else 0, 1)
                    rows = bucket.survivors(query, bar)
                    if not len(rows):
                        continue
                    asked[query] = True
                    scores = bucket.scores(rows, asked)
                    asked[query] = False
                    good = scores >= bar
                    for r, score in zip(rows[good].tolist(), scores[good].tolist(), strict=True):
                        i = bucket.ids[r]
                        entry = (score, 0 if i is None else 1, 0 if i is None else -i)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        rows = [(n, items[n][0], -i if named else None, score) for n, heap in enumerate(best) for score, named, i in heap]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)],
                                         names=["item", "item_id", "doc_id", "score"])
    return run


_HITS = "item int, item_id long, doc_id long, score long"


def _pass(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame | None:
    """The k best documents of each of the queries and some more; None without."""
    numbers: dict[bytes, int] = {}
    for _, terms in items:
        for t in terms:
            numbers.setdefault(t, len(numbers))
    vectors = stored(docs.mapInArrow(_vectors(numbers), _VECTORS), "term-vectors")
    facts = vectors.agg(F.count("*").alias("documents"), F.sum("n").alias("words")).first()
    if not facts.documents or not numbers:
        return None
    holding = np.zeros(len(numbers), np.int64)   # one number for each term of this pass
    for r in vectors.select("terms").mapInArrow(_holding(len(numbers)), "term int, holding long").groupBy("term").agg(
            F.sum("holding").alias("holding")).collect():
        holding[r.term] = r.holding
    weights = np.array([weight(facts.documents, h) for h in holding.tolist()], np.int64)
    queries = []
    for item_id, terms in items:
        query = np.array([numbers[t] for t in terms], np.int64)
        query = query[holding[query] > 0]   # terms of no document add nothing
        if len(query):
            queries.append((item_id, query[np.argsort(-weights[query], kind="stable")]))
    if not queries:
        return None
    ordered = vectors.where(F.length("terms") > 0).mapInArrow(_impacts(weights, facts.documents, facts.words), _IMPACTS).repartitionByRange(
        F.desc("norm"), "salt").sortWithinPartitions(F.desc("norm"))
    buckets = stored(ordered.mapInArrow(_into_buckets, _BUCKETS), "norm-buckets")
    drop_stored(vectors)
    cut = buckets.agg(F.percentile_approx("longest", 1 - LEADING, 10_000).alias("cut")).first().cut

    def hits(part: DataFrame, least: list[int]) -> DataFrame:
        return part.mapInArrow(_search(queries, least, len(numbers), k), _HITS)

    leading = stored(hits(buckets.where(F.col("longest") >= cut), [0] * len(queries)), "leading-hits")
    kth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    least = [0] * len(queries)
    for r in leading.withColumn("place", kth).where(F.col("place") == k).collect():   # at most one row a query
        least[r.item] = r.score
    return leading.unionByName(hits(buckets.where(F.col("longest") < cut), least))


def top_k(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for every item the k documents with
    the highest score above 0, equal scores by ascending id; fewer if fewer
    have one.

    Texts count whole; null and empty ones have no terms.  Documents that
    repeat an id are ranked each; one without id ranks behind those with an id
    of the same score.  Of an item that is repeated the smallest text is asked,
    a null item id is an item like others, an item without terms has no rows.
    Without documents or items there are no rows; other columns are ignored,
    whatever their names.  Scores must lie below 2^63, which texts of under
    10^8 different terms can't reach.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.make_valid_utf8(F.col(text_col)).alias("text"))
    asked = stored(items.groupBy(F.col(item_col).cast("long").alias("item_id")).agg(
        F.min(F.make_valid_utf8(F.col(item_text_col))).alias("text")).mapInArrow(_item_terms, "item_id long, terms array<binary>"), "item-terms")
    whole = asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    passes = max(1, -(-whole // TERMS))
    hits = None
    for number in range(passes):
        mine = F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(passes)) == number
        part = [(r.item_id, [bytes(t) for t in r.terms]) for r in asked.where(mine).collect()]
        found = _pass(wanted, part, k)
        if found is not None:
            found = found.select("item_id", "doc_id", "score")
            hits = found if hits is None else hits.unionByName(found)
    out = "item_id long, rank int, doc_id long, score long"
    if hits is None:
        return spark.createDataFrame([], out)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
