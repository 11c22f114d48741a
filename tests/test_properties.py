"""Randomised checks of the dialect helpers against plain-Python models of
the source rules (one Spark job per helper, a few hundred cases each)."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from quaysight.functions import ora_concat, ora_substr, round_share, trunc_ratio_pct

RNG = random.Random(20240110)


def model_substr(s, start, length):
    """SUBSTR of the source dialect: '' is NULL, out of range is NULL."""
    if s is None or s == "" or (length is not None and length < 1):
        return None
    n = len(s)
    if start == 0:
        start = 1
    if start > 0:
        if start > n:
            return None
        i = start - 1
    else:
        if -start > n:
            return None
        i = n + start
    out = s[i:] if length is None else s[i:i + length]
    return out or None


def test_substr_model(spark):
    alphabet = "ab#Z9 "
    cases = []
    for _ in range(400):
        s = RNG.choice([None, ""] + ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(1, 7)))] * 6)
        start = RNG.randint(-9, 9)
        length = RNG.choice([None, RNG.randint(-2, 9)])
        cases.append((s, start, length))
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string")
    # start is a literal in every use; group the cases by (start, length) so
    # that each expression keeps literal arguments
    exprs = {}
    for i, (_, start, length) in enumerate(cases):
        exprs.setdefault((start, length), []).append(i)
    got = {}
    for (start, length), ids in exprs.items():
        sub = rows.filter(F.col("i").isin(ids)).select("i", ora_substr(F.col("s"), start, length).alias("o"))
        got.update({r.i: r.o for r in sub.collect()})
    bad = [(c, got[i], model_substr(*c)) for i, c in enumerate(cases) if got[i] != model_substr(*c)]
    assert not bad, bad[:5]


def test_concat_model(spark):
    vals = [None, "", "a", "bc"]
    cases = [(RNG.choice(vals), RNG.choice(vals), RNG.choice(vals)) for _ in range(200)]
    df = spark.createDataFrame(cases, "a string, b string, c string")
    got = [r[0] for r in df.select(ora_concat("a", "b", "c")).collect()]
    want = ["".join(v or "" for v in c) or None for c in cases]
    assert got == want


def test_share_and_ratio_models(spark):
    cases = []
    for _ in range(500):
        whole = RNG.choice([0, RNG.randint(1, 50), RNG.randint(1, 10**9)])
        part = RNG.randint(0, whole) if whole else 0
        cases.append((part, whole))
    df = spark.createDataFrame(cases, "p long, w long")
    got = [tuple(r) for r in df.select(round_share("p", "w"), trunc_ratio_pct("p", "w")).collect()]
    for (p, w), (share, ratio) in zip(cases, got):
        if w == 0:
            assert share is None and ratio is None
            continue
        exact = Fraction(100 * p, w)
        assert share == int(exact + Fraction(1, 2)), (p, w, share)   # half away from zero (p >= 0)
        assert ratio == int(exact), (p, w, ratio)                     # truncation toward zero
