"""Toxicity by classifier chains.

Categories are predicted one after another: each category's linear model also
reads the probabilities of the earlier ones.  In training those come from
out-of-fold predictions (a model never feeds on its own training rows).  The
weights are one vector of fixed length per category over hashed words and
word beginnings; every document is scored whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Hashed features of a model.
FEATURES = 1 << 18
# Most labelled rows that the models are fitted on, taken by seeded hash.
TRAINING_ROWS = 8_000
FOLDS = 4
PREFIX = 5
LEVELS = 5
SEED = 29
THRESHOLD = 0.5
# The chain's categories in order, as conditions on the label columns.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
_PUNCTUATION = bytes.maketrans(b".,;:!?\"'()[]{}*%&#$-_", b" " * 21)


def features(text: str | None) -> np.ndarray:
    """Hashed features of a text, whatever punctuation stands at its words:
    its distinct words, and the first PREFIX bytes of words, each with the
    levels that its share of the words reaches (1, 2, 4, 8 and 16 in 512)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_PUNCTUATION).split()
    if not words:
        return np.empty(0, np.int64)
    whole = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    start, count = np.unique(np.fromiter((zlib.crc32(w[:PREFIX]) for w in words), np.int64, len(words)), return_counts=True)
    share = count * (512 / len(words))
    levels = [start[share >= 1 << k] * 31 + 7919 * (k + 1) for k in range(LEVELS)]
    return np.unique(np.concatenate((whole, *levels)) % FEATURES)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _fit(rows: Sequence[np.ndarray], chain: np.ndarray, y: np.ndarray, epochs: int = 200,
         rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression with an L1 penalty by proximal AdaGrad: (weights
    over the hashed words, weights over chain probabilities and constant).

    Both classes weigh the same.  The penalty is about the noise that a word's
    gradient has by chance, so words that tell nothing get no weight; words
    whose first gradient is below half the penalty are not tried at all.  The
    words that keep a weight are then fitted again with a slight L2 penalty.
    """
    w, c = np.zeros(FEATURES), np.zeros(chain.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        c[-1] = 0.0 if not len(y) else (6.0 if y[0] else -6.0)
        return w, c
    weight = np.where(y == 1, 1 / (2 * y.sum()), 1 / (2 * (len(y) - y.sum())))
    penalty = 0.2 / math.sqrt(min(y.sum(), len(y) - y.sum()))
    index = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    first = np.abs(np.bincount(index, ((y - 0.5) * weight)[owner], FEATURES))
    used = np.flatnonzero((first > penalty / 2) & (np.bincount(index, minlength=FEATURES) > 2))
    extra = np.column_stack((chain, np.ones(len(y))))
    for l1, l2 in ((penalty, 0.0), (0.0, 1e-4)):
        place = np.full(FEATURES, -1, np.int32)
        place[used] = np.arange(len(used))
        local = place[index]
        who, local = owner[local >= 0], local[local >= 0]
        v, gv = np.zeros(len(used)), np.full(len(used), 1e-8)
        c, gc = np.zeros(len(c)), np.full(len(c), 1e-8)
        for _ in range(epochs):
            err = (_sigmoid(np.bincount(who, v[local], len(rows)) + extra @ c) - y) * weight
            g = np.bincount(local, err[who], len(used)) + l2 * v
            gv += g * g
            step = rate / np.sqrt(gv)
            v -= step * g
            v = np.sign(v) * np.maximum(0, np.abs(v) - step * l1)
            g = extra.T @ err
            gc += g * g
            c -= rate * g / np.sqrt(gc)
        used, v = used[v != 0], v[v != 0]
    w[used] = v
    return w, c


def _predict(rows: Sequence[np.ndarray], chain: np.ndarray, model) -> np.ndarray:
    w, c = model
    z = np.array([w[r].sum() for r in rows], float)
    return _sigmoid(z + np.column_stack((chain, np.ones(len(rows)))) @ c)


def fit_chain(rows: Sequence[np.ndarray], labels: np.ndarray, folds: np.ndarray):
    """Models in chain order from labelled rows; ``labels`` has a column per
    category.  Later models are trained on out-of-fold probabilities."""
    chain, models = np.empty((len(rows), 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(_fit(rows, chain, y))
        out = np.zeros(len(rows))
        for f in range(FOLDS):
            there, held = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            part = _fit([rows[i] for i in there], chain[there], y[there])
            out[held] = _predict([rows[i] for i in held], chain[held], part)
        chain = np.column_stack((chain, out))
    return models


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, id_col: str = "doc_id",
                  text_col: str = "text"):
    """(features, labels, folds) of at most ``most`` labelled documents, the
    first by seeded hash of the id.  A category that a row leaves null is 0;
    of repeated labels of an id the higher value holds, of repeated documents
    the smallest text."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        *(F.max(F.coalesce(F.expr(f"CAST({rule} AS INT)"), F.lit(0))).alias(name) for name, rule in CATEGORIES))
    order = F.xxhash64(F.lit(SEED), F.col("id"))
    picked = marks.orderBy(order, "id").limit(most)
    # at most ``most`` rows, and as many groups
    found = F.broadcast(picked).join(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "id")
    found = found.groupBy("id", *(n for n, _ in CATEGORIES)).agg(F.min("text").alias("text"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(batch.column(n) for n, _ in CATEGORIES),
                 pa.array([r.astype(np.int32).tobytes() for r in rows], pa.binary())],
                names=["id", *(n for n, _ in CATEGORIES), "at"])

    schema = "id long, " + ", ".join(f"{n} int" for n, _ in CATEGORIES) + ", at binary"
    got = sorted(found.select("id", *(n for n, _ in CATEGORIES), "text").mapInArrow(shrink, schema).collect(),
                 key=lambda r: (r.id, r["at"]))
    rows = [np.frombuffer(r["at"], np.int32) for r in got]
    marks_of = np.array([[r[n] for n, _ in CATEGORIES] for r in got], int).reshape(len(got), len(CATEGORIES))
    folds = np.array([zlib.crc32(str(r.id).encode()) % FOLDS for r in got], int)
    return rows, marks_of, folds


def train(docs: DataFrame, labels: DataFrame, **options):
    """The chain's models, fitted on a bounded sample of labelled rows."""
    return fit_chain(*training_rows(docs, labels, **options))


def score(docs: DataFrame, models, id_col: str = "doc_id", text_col: str = "text",
          keep: Sequence[str] = ()) -> DataFrame:
    """``id_col``, the columns named in ``keep``, ``p_<category>`` per category
    and ``toxic`` (1 where the last category reaches THRESHOLD), for every row.

    Rows are scored one by one: null ids and repeated rows need no care; null
    or empty texts get the models' constants.  Empty tables give no rows.
    """
    names = [n for n, _ in CATEGORIES]
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast([(w.astype(np.float32), c) for w, c in models])   # FEATURES floats per category
    columns = list(dict.fromkeys([id_col, *keep]))
    taken = docs.select(*columns, F.col(text_col).cast("string").alias("__text"))
    clash = {f"p_{n}" for n in names} | {"toxic"}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1] if f.name not in clash)
    passed = [i for i, c in enumerate(columns) if c not in clash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            rows = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            chain = np.empty((len(rows), 0))
            for model in fitted:
                chain = np.column_stack((chain, _predict(rows, chain, model)))
            toxic = (chain[:, -1] >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in passed), *(pa.array(chain[:, k]) for k in range(chain.shape[1])), pa.array(toxic)],
                names=[*(columns[i] for i in passed), *(f"p_{n}" for n in names), "toxic"])

    return taken.mapInArrow(run, ", ".join([schema, *(f"p_{n} double" for n in names), "toxic int"]))
