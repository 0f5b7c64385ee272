"""Draws as arrays against plain numpy, multinomial draws against their distribution, locked intervals against a plain bootstrap."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest

from cohortspark.operators import draws as D
from cohortspark.operators import resample as H

PAIR = "grp string, y int, pred_a int, pred_b int"


def some_pairs(n, groups, seed, classes=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = rng.randrange(classes)
        rows.append((f"g{rng.randrange(groups)}", y, y if rng.random() < 0.6 else rng.randrange(classes), y if rng.random() < 0.75 else rng.randrange(classes)))
    return rows


def macro(y, p, w, k):
    c = np.zeros((k, k))
    np.add.at(c, (y, p), w)
    return float(np.mean(2 * np.diag(c) / np.maximum(c.sum(0) + c.sum(1), 1))), float(np.trace(c) / max(c.sum(), 1))


def weights_of(sums, keys):
    """Arrays over draws by cell, blocks put together."""
    out = {}
    for row in sums.orderBy("block").collect():
        out.setdefault(tuple(row[k] for k in keys), []).extend(row.v)
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("numbers", [D.mixed_numbers, D.md5_numbers])
def test_vector_sums_are_brute_force(spark, numbers, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["a", "b", None]), rng.randrange(3), rng.randint(-2, 5)) for _ in range(900)]
    df = spark.createDataFrame(rows, "u long, c string, k int, n long")
    monkeypatch.setattr(D, "ROWS", 100)
    got = weights_of(D.vector_sums(df.repartition(5), "u", ["c", "k"], 300, D.hashed(numbers, D.poisson, "s")), ["c", "k"])
    every = numbers("s", np.arange(300), [str(u) for u in range(40)])
    want = {}
    for u, c, k, n in rows:
        w = np.ones(301) if u is None else np.concatenate([[1], D.poisson(every[u])])
        want[c, k] = want.get((c, k), 0) + n * w
    assert got.keys() == want.keys() and all((got[x] == want[x]).all() for x in want)


def test_numbers_are_what_sql_makes():
    import duckdb

    from cohortspark.plans.q_resample import _numbers

    u = duckdb.sql(f"WITH pr AS (SELECT 'g' || i AS grp FROM range(30) t(i)), {_numbers('us', 'seed', 50)} SELECT grp, draw, u FROM us").df()
    mine = D.mixed_numbers("seed", np.arange(50), [f"g{i}" for i in range(30)])
    assert all(mine[int(g[1:]), d] == x for g, d, x in u.itertuples(index=False))
    many = D.mixed_numbers(7, np.arange(400), [str(i) for i in range(2_000)])
    assert abs(D.poisson(many).mean() - 1) < 0.01 and abs(D.poisson(many).var() - 1) < 0.02 and abs(D.coin(many).mean() - 0.5) < 0.005
    assert abs(np.corrcoef(many[:, 0], many[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(many[0], many[1])[0, 1]) < 0.2


def test_cluster_draws_are_brute_force(spark):
    rows = some_pairs(300, 25, 2)
    out = H.cluster_draws(spark.createDataFrame(rows, PAIR), 20, 9).toPandas()
    got = {(r.draw, r.y, r.pred_a, r.pred_b): r.n for r in out.itertuples() if r.n}
    want = {}
    for d in range(-1, 20):
        for g, *cell in rows:
            u = int(hashlib.md5(f"9|{d}|{g}".encode()).hexdigest()[:8], 16)
            w = 1 if d < 0 else sum(u >= t for t in D.POISSON)
            want[d, *cell] = want.get((d, *cell), 0) + w
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("bucket", [D.BUCKET, 8])
def test_multinomial_draws_are_exact(spark, monkeypatch, bucket):
    """Every draw has exactly as many picks as units; counts have the multinomial's means, variances and covariances; strata keep their totals."""
    monkeypatch.setattr(D, "BUCKET", bucket)
    n, draws = 60, 2_000
    units = spark.createDataFrame([(i, "xyz"[i % 3], 1 + i % 4, 1) for i in range(n)], "u int, s string, m int, n int")
    got = weights_of(D.multinomial_sums(units, ["u"], ["u"], draws, 5), ["u"])
    w = np.stack([got[(i,)] for i in range(n)])
    assert (w[:, 0] == 1).all() and (w[:, 1:].sum(0) == n).all()
    assert np.allclose(w[:, 1:].mean(1), 1, atol=5 * math.sqrt(1 / draws)) and abs(w[:, 1:].var(1).mean() - (1 - 1 / n)) < 0.05
    c = np.cov(w[:, 1:])
    assert abs(c[~np.eye(n, dtype=bool)].mean() + 1 / n) < 0.004
    again = weights_of(D.multinomial_sums(units.repartition(7), ["u"], ["u"], draws, 5), ["u"])
    assert all((again[k] == got[k]).all() for k in got)
    own = weights_of(D.multinomial_sums(units, ["u"], ["u"], draws, 5, "s", "m"), ["u"])
    for s in range(3):
        ids = [i for i in range(n) if i % 3 == s]
        mass = np.array([1 + i % 4 for i in ids])
        v = np.stack([own[(i,)] for i in ids])
        assert (v[:, 0] == mass).all() and (v.sum(0) == mass.sum()).all() and np.allclose(v[:, 1:].mean(1), mass, atol=0.35)


def plain_locked(rows, k, draws, seed):
    """Row-stratified and group intervals by numpy, with rejection."""
    g, y, a, b = (np.array(x) for x in zip(*rows, strict=True))
    names, of = np.unique(g, return_inverse=True)
    rng, out = np.random.default_rng(seed), {"row": [], "group": []}
    rejected = 0
    for _ in range(draws):
        w = np.bincount(np.concatenate([rng.choice(pool, len(pool)) for c in range(k) if len(pool := np.flatnonzero(y == c))]), minlength=len(y))
        out["row"].append([macro(y, p, w, k) for p in (a, b)])
        while True:
            w = np.bincount(rng.integers(len(names), size=len(names)), minlength=len(names))[of]
            if all(w[y == c].sum() for c in range(k)):
                break
            rejected += 1
        out["group"].append([macro(y, p, w, k) for p in (a, b)])
    return {x: np.array(v) for x, v in out.items()}, rejected


def test_locked_intervals_match_a_plain_bootstrap(spark):
    rows = [r for r in some_pairs(400, 50, 4) if r[1] != 2] + [("rare0", 2, 2, 1), ("rare1", 2, 2, 2), ("rare1", 2, 0, 2)]
    draws = 3_000
    out = D.locked_intervals(spark.createDataFrame(rows, PAIR), 3, draws, 11).toPandas().set_index(["metric", "role"])
    want, rejected = plain_locked(rows, 3, draws, 1)
    assert len(out) == 6 and abs(out["rejected"].iloc[0] / draws - rejected / draws) < 0.05 and rejected > 0
    g, y, a, b = (np.array(x) for x in zip(*rows, strict=True))
    for m, metric in enumerate(("macro_f1", "accuracy")):
        for s, role in ((0, "reference"), (1, "candidate"), (None, "delta")):
            take = lambda v: v[:, s, m] if s is not None else v[:, 1, m] - v[:, 0, m]
            for kind in ("row", "group"):
                low, high = np.quantile(take(want[kind]), [0.025, 0.975])
                assert out.loc[(metric, role), f"{kind}_low"] == pytest.approx(low, abs=0.012) and out.loc[(metric, role), f"{kind}_high"] == pytest.approx(high, abs=0.012)
            point = [macro(y, p, np.ones(len(y)), 3)[m] for p in (a, b)]
            assert out.loc[(metric, role), "point"] == pytest.approx(point[s] if s is not None else point[1] - point[0])


def test_rejection_gives_up(spark):
    rows = [("a", 0, 0, 0), ("b", 1, 1, 1)]  # of two groups both are needed: half of all draws fail, and class 2 always does
    with pytest.raises(ValueError, match="too few draws"):
        D.locked_intervals(spark.createDataFrame(rows, PAIR), 3, 20, 1)


def test_methods_meet_the_same_rows(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        y = i % 3
        one = y if rng.random() < 0.7 else (y + 1) % 3
        rows += [(i, y, "one", one), (i, y, "same", one), (i, y, "two", y if rng.random() < 0.9 else (y + 1) % 3)]
    df = spark.createDataFrame(rows, "id int, y int, model string, pred int")
    same = D.method_intervals(df, 3, 400, 3, "same", "one").toPandas().set_index(["metric", "role"])
    assert (same.loc[("macro_f1", "same - one"), ["mean", "low", "high", "p_positive"]] == 0).all()
    out = D.method_intervals(df, 3, 400, 3, "two", "one").toPandas().set_index(["metric", "role"])
    frame = pd.DataFrame(rows, columns=["id", "y", "model", "pred"])
    for model, f in frame.groupby("model"):
        acc = (f["y"] == f["pred"]).mean()
        assert out.loc[("accuracy", model), "mean"] == pytest.approx(acc, abs=0.01)
        assert out.loc[("accuracy", model), "high"] - out.loc[("accuracy", model), "low"] == pytest.approx(2 * 1.96 * math.sqrt(acc * (1 - acc) / 240), rel=0.2)
    assert out.loc[("accuracy", "two - one"), "p_positive"] == 1 and (out["draws"] == 400).all()


def test_comparisons_do_not_depend_on_partitioning(spark):
    rows = [(i, f"g{i % 30}", i % 3, m, (i * s + i // 7) % 3) for i in range(200) for m, s in (("a", 1), ("b", 2), ("c", 5))]
    preds = spark.createDataFrame(rows, "id int, grp string, y int, model string, pred int")
    declared = spark.createDataFrame([("b-a", "a", "b"), ("c-a", "a", "c")], "comparison string, reference string, candidate string")
    one, two = (sorted(map(tuple, D.comparisons_of(preds.repartition(n), declared, 3, 300, 300, 1).collect())) for n in (1, 6))
    assert one == two and len(one) == 2
