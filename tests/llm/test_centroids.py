"""Clustering over zone maps against plain rounds over all pairs."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from quaysight.llm import centroids
from quaysight.llm.registry import ORACLE_SQL, QUERIES

from tests.compare import compare, duck
from tests.conftest import MEDIUM

SCHEMA = "vec_id long, embedding array<double>, cluster string, n int"


def plain(rows, k, rounds, width, scale, salt="2:"):
    """Rows (id, vector) -> multiset of (id, cluster, distance, inertias, hash), in Python's integers."""
    kept = [(i, v) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(x * scale) if abs(x) < 2.0 ** 52 else int(x) * scale for x in v]) for i, v in kept]
    first = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v, w) for (i, v), (_, w) in zip(kept, whole, strict=True) if i is not None)
    centers = [w for *_, w in first[:k]]
    if not centers:
        return Counter()

    def assign():
        out = []
        for _, w in whole:
            out.append(min((sum((a - b) ** 2 for a, b in zip(w, c, strict=True)), j) for j, c in enumerate(centers)))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centers)):
            own = [w for (_, w), (_, c) in zip(whole, found, strict=True) if c == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(whole, found, strict=True))


def result(df):
    def number(r, name):
        assert (r[name] is None) == (r["wide_" + name] is not None)
        return r[name] if r[name] is not None else int(r["wide_" + name])

    return Counter((r.vec_id, r.cluster, number(r, "distance"), number(r, "cluster_inertia"), number(r, "inertia"), r.centroid_sha256)
                   for r in df.collect())


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_once_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = centroids.hilbert_keys(cells, bits)
    order = sorted(range(len(cells)), key=lambda i: keys[i].tobytes())
    assert len({k.tobytes() for k in keys}) == len(cells)
    steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = rng.integers(-50, 50, (rng.integers(1, 30), 4)) + rng.integers(-200, 200, 4)
        c = rng.integers(-200, 200, (12, 4))
        c[3] = c[7]
        near = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        ties = set(np.flatnonzero((near == near.min(axis=1)[:, None]).any(axis=0)))
        found = centroids.candidates(x.min(axis=0), x.max(axis=0), c)
        assert ties <= set(found.tolist()) and (np.diff(found) > 0).all()


def test_whole_table_and_sql(spark):
    df = QUERIES["op12_zone_maps"](spark, MEDIUM)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()]
    assert result(df) == plain(rows, 40, 5, 64, 256)
    con = duck(MEDIUM)
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{MEDIUM}/embeddings.parquet')")
    res = compare(df, con, ORACLE_SQL["op12_zone_maps"])
    assert res["match"], res


def test_groups_leave_few_candidates(spark, monkeypatch):
    """Far groups: blocks of one group have one candidate and give their stored sum."""
    monkeypatch.setattr(centroids, "BLOCK", 16)
    rnd = random.Random(3)
    rows = [(i, [float(100 * (g := i % 6)) + rnd.random(), -50.0 * g + rnd.random(), rnd.random()], "x", i) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert result(centroids.cluster(df, 12, 3, 3)) == plain([r[:2] for r in rows], 12, 3, 3, 256)
    blocks = [r.asDict() for r in centroids.blocks_on_curve(df, "vec_id", "embedding", 3, 256).collect()]
    assert sum(b["n"] for b in blocks) == 600
    one_each = [[25600 * g, -12800 * g, 0] for g in range(6)]
    left = [len(centroids.candidates(*(np.array(centroids._numbers(b[e]), float) for e in ("low", "high")), np.array(one_each, float)))
            for b in blocks]
    assert sum(n == 1 for n in left) > len(left) / 2 and sum(left) < 3 * len(left)


@pytest.mark.parametrize("size", [1e-3, 3.0, 1e5, 1e7, 1e20, 1e306])
def test_sizes_of_numbers(spark, size):
    """Small vectors beside ones whose distances go beyond doubles and 64 bits."""
    rnd = random.Random(5)
    rows = [(i, [(size if i % 7 == 3 else 1.0) * (rnd.random() - 0.5) for _ in range(2)], "x", i) for i in range(80)]
    assert result(centroids.cluster(spark.createDataFrame(rows, SCHEMA), 5, 3, 2)) == plain([r[:2] for r in rows], 5, 3, 2, 256)


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, [0.5, 0.5], None, 1), (1, [0.5, 0.5], "x", 2), (2, [-0.5, 0.25], "x", 3), (2, [4.0, 4.0], "x", 3), (None, [9.0, 9.0], "x", 4),
            (3, None, "x", 5), (4, [1.0], "x", 6), (5, [1.0, None], "x", 7), (6, [1.0, nan], "x", 8), (7, [inf, 0.0], "x", 9),
            (8, [1.0, 2.0, 3.0], "x", 10), (9, [], "x", 11)] + [(100 + i, [0.125, 0.125], "same", i) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k in (1, 3, 40, 1000):
        assert result(centroids.cluster(df, k, 2, 2)) == plain([r[:2] for r in rows], k, 2, 2, 256)
    assert centroids.cluster(df.limit(0), 3, 2, 2).count() == 0
    assert centroids.cluster(df.where("vec_id IS NULL"), 3, 2, 2).count() == 0
    with pytest.raises(ValueError, match="width"):
        centroids.cluster(df, 3, 2, 65)


def test_equal_rows_are_dealt_over_partitions(spark, monkeypatch):
    """A vector that holds all rows doesn't end up in one task."""
    monkeypatch.setattr(centroids, "BLOCK", 50)
    df = spark.range(4000).selectExpr("id AS vec_id", "array(1D, 2D) AS embedding").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = centroids.blocks_on_curve(df, "vec_id", "embedding", 2, 256)
        assert blocks.count() >= 4000 / 50 and len(blocks.inputFiles()) >= 6
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
