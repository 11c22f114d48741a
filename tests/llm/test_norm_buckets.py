"""Search over norm buckets against plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quaysight.llm import norm_buckets
from quaysight.llm.registry import ORACLE_SQL, QUERIES

from tests.compare import compare, duck
from tests.conftest import MEDIUM, SMALL

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """Rows (id, text) of both -> set of (item, rank, doc, score)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    total, words = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        if i not in asked or asked[i] is None or t is not None and t < asked[i]:
            asked[i] = t
    out = Counter()
    for item, text in asked.items():
        found = []
        for i, c, n in counts:
            m = 10 + (90 * n * total) // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda x: x[:3])
        out.update((item, rank, f[3], -f[0]) for rank, f in enumerate(found[:k], 1))
    return out


def result(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_whole_table_and_sql(spark):
    df = QUERIES["op13_norm_buckets"](spark, MEDIUM)
    con = duck(MEDIUM)
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{MEDIUM}/{t}.parquet')")
    res = compare(df, con, ORACLE_SQL["op13_norm_buckets"])
    assert res["match"], res
    pairs = [[(r[0], r.text) for r in spark.read.parquet(f"{MEDIUM}/{t}.parquet").select(c, "text").collect()]
             for t, c in (("documents", "doc_id"), ("benchmark", "item_id"))]
    assert result(df) == plain(*pairs)


def some_texts(rnd, number):
    words = [f"w{i}" for i in range(400)] + ["Ünï", "日本語", "ÀB"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [rnd.choice([" ", ", ", "\n--"]).join(rnd.choices(words, weights, k=rnd.choice([1, 3, 30, 200]))) for _ in range(number)]


@pytest.mark.parametrize(("bucket", "most", "k"), [(7, 1 << 19, 10), (7, 60, 3), (1024, 1 << 19, 500), (1, 1 << 19, 1)])
def test_buckets_passes_and_k(spark, monkeypatch, bucket, most, k):
    monkeypatch.setattr(norm_buckets, "BUCKET", bucket)
    monkeypatch.setattr(norm_buckets, "TERMS", most)
    rnd = random.Random(bucket + k)
    docs = list(enumerate(some_texts(rnd, 250)))
    items = list(enumerate(some_texts(rnd, 25)))
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert result(norm_buckets.top_k(a, b, k)) == plain(docs, items, k)


def test_odd_rows(spark):
    docs = [(1, "Apple pie", "x", 1), (1, "apple PIE", "y", 2), (None, "apple pie", "z", 3), (2, None, "z", 4), (3, "", "z", 5), (4, " ,.;- ", "z", 6),
            (-5, "apple pie", None, 7), (6, "apple " * 50_000 + "straße", "z", 8)] + [(100 + i, "apple pie pie", "same", 9) for i in range(30)]
    items = [(1, "apple pie apple", 0.5), (1, "apple pie apple", 0.5), (2, None, 0.5), (3, "", 0.5), (None, "STRASSE straße", 0.5),
             (4, "never seen", 0.5), (5, "zzz", 0.5), (5, "pie", 0.5), (6, None, 0.5), (6, "APPLE", 0.5)]
    a = spark.createDataFrame(docs, "doc_id long, text string, item_id string, score int")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id double")
    want = plain([d[:2] for d in docs], [i[:2] for i in items])
    assert result(norm_buckets.top_k(a, b)) == want and want
    for x, y in ((a.limit(0), b), (a, b.limit(0)), (a.where("doc_id IN (2, 3)"), b), (a, b.where("item_id IN (2, 3)")), (a, b.where("item_id = 4"))):
        assert norm_buckets.top_k(x, y).count() == 0


def test_bounds_hold_and_prune():
    """Every document of at least the threshold survives; most others don't."""
    rng = np.random.default_rng(7)
    kept = reached = 0
    for _ in range(60):
        rows = []
        for i in range(200):
            t = np.sort(rng.choice(300, rng.integers(1, 40), False)).astype(np.int32)
            x = (rng.integers(1, 8000, len(t)) * rng.integers(1, 1_000_000, len(t))).astype(np.int64)
            rows.append({"doc_id": i, "norm": math.sqrt(float(x.astype(float) @ x.astype(float))), "terms": t.tobytes(), "impacts": x.tobytes()})
        b = norm_buckets.Bucket({
            "ids": list(range(200)), "longest": max(r["norm"] for r in rows), "norms": np.array([r["norm"] for r in rows]).tobytes(),
            "sizes": np.array([len(r["terms"]) // 4 for r in rows], np.int32).tobytes(),
            "terms": b"".join(r["terms"] for r in rows), "impacts": b"".join(r["impacts"] for r in rows)})
        query = rng.choice(300, 12, False)
        asked = np.zeros(300, bool)
        asked[query] = True
        exact = b.scores(np.arange(200), asked)
        want = [sum(int(x) for t, x in zip(np.frombuffer(r["terms"], np.int32), np.frombuffer(r["impacts"], np.int64), strict=True) if asked[t])
                for r in rows]
        assert exact.tolist() == want
        for least in (1, int(np.sort(exact)[-10]), int(exact.max()), int(exact.max()) + 1, 1 << 60):
            found = b.survivors(query, least)
            assert set(np.flatnonzero(exact >= max(least, 1))) <= set(found.tolist())
        reached += 10
        kept += len(b.survivors(query, int(np.sort(exact)[-10])))
    assert kept < 8 * reached   # of 200 documents a bucket, at most 80


def test_terms_are_the_stated_ones():
    rnd = random.Random(1)
    for _ in range(500):
        text = "".join(chr(rnd.choice((rnd.randrange(0, 128), rnd.randrange(0, 0x500), rnd.randrange(0xE000, 0x11000)))) for _ in range(40))
        assert [t.decode() for t in norm_buckets.terms_of(text)] == terms(text)


def test_small_table(spark):
    assert QUERIES["op13_norm_buckets"](spark, SMALL).count() > 0
