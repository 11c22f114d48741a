"""Near-duplicate components against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Row

from quaysight.llm import parity_join as pj
from quaysight.llm.components import connected_components

from tests.conftest import SMALL


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """{doc_id: (n, component)} by comparing every pair."""
    sets = {}
    for d, t in docs:
        sets.setdefault(d, []).append(shingles(t))
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            for x in sets[a]:
                for y in sets[b]:
                    both = len(x & y)
                    if both and 100 * both >= 75 * (len(x) + len(y) - both):
                        ra, rb = sorted((root(a), root(b)))
                        comp[rb] = ra
    return {d: (len(sets[d][0]), root(d)) for d in ids}


def got(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, n long, component string")
    return [(r.doc_id, r.n_shingles, r.component_id) for r in pj.near_duplicate_components(df).collect()]


def variants(rng, base, copies, edits, vocab):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


def test_matches_brute_force_on_planted_groups(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(50)]
    texts = []
    for length in (1, 2, 3, 4, 5, 6, 7, 9, 12, 17, 30, 60, 130, 300):
        base = [rng.choice(vocab) for _ in range(length)]
        texts += variants(rng, base, 12, 1 + length // 22, vocab)
        texts += [" ".join(base).upper(), " ".join(base + base[:2])]
    # documents that share a long passage and nothing else
    texts += [" ".join(passage + [rng.choice(vocab) for _ in range(60)]) for _ in range(40)]
    rng.shuffle(texts)
    docs = [(i, t, 0, "x") for i, t in enumerate(texts)]
    want = brute([(d, t) for d, t, *_ in docs])
    assert {d: (n, c) for d, n, c in got(spark, docs)} == want
    assert len({c for _, c in want.values()}) < len(want)


def test_matches_brute_force_on_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    rows = pj.near_duplicate_components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_nulls_blanks_repeats_and_empty_table(spark):
    docs = [(1, None, 0, ""), (2, "", 0, ""), (3, " \t\n", 0, ""), (4, "One two", 0, ""), (5, "one\ttwo", 0, ""),
            (None, "one two", 0, ""), (7, "é É", 0, ""), (8, "é é", 0, ""), (9, "a b c d e f", 0, ""),
            (9, "a b c d e f", 0, ""), (10, "x " * 30_000, 0, "")]
    assert sorted(got(spark, docs), key=str) == sorted(
        [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, None), (7, 1, 7), (8, 1, 8),
         (9, 2, 9), (9, 2, 9), (10, 1, 10)], key=str)
    assert got(spark, []) == []


def test_every_linked_pair_shares_a_posted_word():
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 31, 33, 64, 100, 255, 257, 600]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = int(rng.integers(0, n // 4 + 1))
            add = int(rng.integers(0, n // 3 + 1))
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 2**63, add).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 4 * both >= 3 * (len(a) + len(b) - both):
                assert set(pj.posted_words(a)) & set(pj.posted_words(b))
                x, y = (np.frombuffer(pj.bit_sketch(s), np.uint8) for s in (a, b))
                w = min(len(x), len(y))
                far = int(np.bitwise_count(pj.folded(x, w) ^ pj.folded(y, w)).sum())
                assert far <= len(a) + len(b) - 2 * both <= pj.most_difference(len(a), len(b))


@pytest.mark.parametrize("block", [2, 5])
def test_blocks_do_not_lose_pairs(spark, monkeypatch, block):
    """Members of one group in several components are met across blocks."""
    monkeypatch.setattr(pj, "BLOCK", block)
    sk = pj.bit_sketch(np.arange(20, dtype=np.uint64))
    prints = spark.createDataFrame([Row(doc_id=i, digest=bytes([i]), n=20, sketch=sk) for i in range(12)])
    groups = spark.createDataFrame([Row(key=1, doc_id=i, n=20, rep=0) for i in range(12)])
    comps = spark.createDataFrame([Row(node=1, component=0), Row(node=0, component=0)])
    pairs = {(r.a, r.b) for r in pj.crossing_pairs(groups, comps, prints, False).collect()}
    assert pairs == {(i, j) for i in range(12) for j in range(i + 1, 12)} - {(0, 1)}
    few = {(r.a, r.b) for r in pj.crossing_pairs(groups, comps, prints, True).collect()}
    assert few <= pairs and {x for p in few for x in p} == set(range(12))


def test_group_scan_carries_over_batches():
    import pyarrow as pa

    rows = [(1, 5, 10), (2, 1, 8), (2, 2, 9), (2, 3, 10), (2, 4, 30), (2, 6, 31), (3, 9, 4)]
    def batches(cut):
        for part in (rows[:cut], rows[cut:]):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in range(3)],
                                             names=["key", "doc_id", "n"])
    for cut in range(len(rows) + 1):
        out = [tuple(c.to_pylist() for c in b.columns) for b in pj._group_batches(batches(cut))]
        flat = sorted(t for b in out for t in zip(*b, strict=True))
        assert flat == [(2, 1, 8, 1), (2, 2, 9, 1), (2, 3, 10, 1), (2, 4, 30, 4), (2, 6, 31, 4)]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(30)] + [(7, 7), (None, 3), (200, 201)] * 2
    out = connected_components(spark.createDataFrame(chain, "a long, b long")).collect()
    comp = {r.node: r.component for r in out}
    assert comp == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert len(out) == len(comp)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
