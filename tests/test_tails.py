"""Exact quantiles, p-values and areas of weighted draws, against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import special as S
from cohortspark.operators import draws as D
from cohortspark.operators import metrics as M
from cohortspark.operators import resample as H
from cohortspark.operators.quantiles import quantiles


def test_quantiles_are_numpy(spark):
    """Groups of all sizes, a value that most rows share, negative zeros, nulls in value and key, one row."""
    rng = random.Random(1)
    rows = [("big", rng.choice([7.0, 7.0, 7.0, rng.gauss(0, 1e3)])) for _ in range(20_000)] + [("one", 3.5), ("two", -1.0), ("two", 4.0), ("none", None)]
    rows += [(None, float(k)) for k in range(11)] + [("same", 2.0)] * 500 + [(f"g{k % 40}", rng.random()) for k in range(900)]
    shares = [0.0, 0.025, 0.25, 0.5, 0.75, 0.95, 1.0]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: r.q for r in quantiles(df, "v", shares, ["k"]).collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(np.quantile(v, shares).tolist(), abs=1e-9)
    assert quantiles(df.where("k = 'big'"), "v", [0.5]).first().q == [pytest.approx(np.median(want["big"]))]
    assert quantiles(df.where("false"), "v", [0.5]).first().q == [None] and quantiles(df.where("false"), "v", [0.5], ["k"]).count() == 0


def t_tail(t, n):
    """Two-sided tail of Student's distribution by its finite sums."""
    a = math.atan(abs(t) / math.sqrt(n))
    if n % 2:
        total, term = 0.0, math.cos(a)
        for k in range(1, (n - 1) // 2 + 1):
            total += term
            term *= math.cos(a) ** 2 * (2 * k) / (2 * k + 1)
        return 1 - 2 / math.pi * (a + math.sin(a) * total)
    total, term = 0.0, 1.0
    for k in range(1, n // 2 + 1):
        total += term
        term *= math.cos(a) ** 2 * (2 * k - 1) / (2 * k)
    return 1 - math.sin(a) * total


def test_tails_are_tabulated(spark):
    points = [(t, n) for n in (1, 2, 3, 4, 5, 10, 17, 60, 301, 2_000) for t in (0.0, 1e-4, 0.1, 0.7, 1.0, 1.96, -2.5, 4.0, 12.0)]
    df = spark.createDataFrame(points, "t double, n long")
    for r in df.withColumn("p", S.t_two_sided(F.col("t"), F.col("n"))).collect():
        assert r.p == pytest.approx(t_tail(r.t, r.n), abs=1e-9)
    assert S.t_two_sided(F.lit(float("inf")), F.lit(5)) is not None
    edge = spark.range(1).select(S.t_two_sided(F.lit(float("inf")), F.lit(5)).alias("a"), S.t_two_sided(F.lit(1.0), F.lit(0)).alias("b")).first()
    assert edge.a == 0 and edge.b is None
    known = [(0.3, 0.9999906941986655), (0.5, 0.9639452436648751), (1.0, 0.26999967167735456), (1.5, 0.02221796261652513), (2.0, 0.0006709252557796953)]  # fixed values
    for x, want in known:
        assert spark.range(1).select(S.kolmogorov_tail(F.lit(x)).alias("p")).first().p == pytest.approx(want, abs=1e-9)
    gammas = spark.createDataFrame([(x / 7,) for x in range(1, 400, 5)], "x double").withColumn("g", S.log_gamma(F.col("x"))).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in gammas)


def test_correlated_columns_have_small_p(spark):
    rng = random.Random(3)
    rows = [(k, "a", rng.random(), rng.random()) for k in range(200)] + [(k, "b", x := rng.random(), x + rng.gauss(0, 0.3)) for k in range(200)] + [(k, "c", float(k), float(k)) for k in range(9)]
    out = {r.g: r for r in M.spearman_test(spark.createDataFrame(rows, "id int, g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert out["a"].p > 0.01 and out["b"].p < 1e-9 and out["c"].p == 0 and out["c"].spearman == pytest.approx(1)
    r, n = out["a"].spearman, out["a"].n
    assert out["a"].p == pytest.approx(t_tail(r * math.sqrt((n - 2) / (1 - r * r)), n - 2), abs=1e-9)


def test_areas_of_draws_are_brute_force(spark):
    """Many ranges and chunks, ties over range borders, groups with many rows, a null group."""
    rng = random.Random(4)
    rows = [(None if k % 50 == 0 else f"g{rng.randrange(30)}", rng.choice([0.5, rng.random(), round(rng.random(), 1)]), int(rng.random() < 0.4)) for k in range(3_000)]
    out = {r.draw: r.auroc for r in H.auroc_draws(spark.createDataFrame(rows, "grp string, score double, hit int").repartition(4), 12, "s").collect()}
    assert set(out) == set(range(-1, 12))
    for d in range(-1, 12):
        w = [1 if d < 0 or g is None else sum(int(hashlib.md5(f"s|{d}|{g}".encode()).hexdigest()[:8], 16) >= t for t in D.POISSON) for g, _, _ in rows]
        s, h, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array(w, float)
        order = np.argsort(s, kind="stable")
        s, pos, neg = s[order], (w * h)[order], (w * (1 - h))[order]
        cum = np.concatenate([[0], np.cumsum(neg)])
        low, high = np.searchsorted(s, s, "left"), np.searchsorted(s, s, "right")
        area = (pos * (cum[low] + (cum[high] - cum[low]) / 2)).sum()
        assert out[d] == pytest.approx(area / (pos.sum() * neg.sum()), abs=1e-12)


def test_rank_correlation_within_rows(spark):
    import pandas as pd

    rng = random.Random(6)
    rows = [(k, [float(rng.randrange(4 + k % 9)) for _ in range(n)], [rng.choice([0.5, rng.random()]) for _ in range(n)]) for k in range(60) for n in [2 + k % 17]]
    rows += [(100, [1.0, 1.0], [2.0, 2.0]), (101, [1.0, 1.0], [2.0, 3.0]), (102, [], []), (103, [1.0], [1.0, 2.0])]
    out = {r.k: r.s for r in spark.createDataFrame(rows, "k int, a array<double>, b array<double>").select("k", S.array_spearman(F.col("a"), F.col("b")).alias("s")).collect()}
    for k, a, b in rows[:60]:
        if len(set(a)) > 1 and len(set(b)) > 1:
            assert out[k] == pytest.approx(float(np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]), abs=1e-9)
    assert (out[100], out[101], out[102], out[103]) == (1, 0, None, None)
