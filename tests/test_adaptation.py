"""Adaptation methods and the geometry baseline against numpy."""

import numpy as np
import pytest

from cohortspark.operators import adaptation as A
from cohortspark.operators import heads as Z
from cohortspark.operators import probs as P

K = 3
SOURCE = [0.5, 0.3, 0.2]


def table():
    rng = np.random.default_rng(11)
    out = []
    for model, skill in (("a", 1.2), ("b", 2.0)):
        for k in range(600):
            y = int(rng.choice(K, p=[0.2, 0.3, 0.5]))
            z = rng.normal(size=K)
            z[y] += skill
            p = np.exp(z) * SOURCE
            out.append((model, "train" if k % 3 else "val", k, k % 40, y, (p / p.sum()).tolist()))
    return out


def macro(y, pred):
    f1 = []
    for k in range(K):
        tp = np.sum((y == k) & (pred == k))
        f1.append(2 * tp / max(np.sum(y == k) + np.sum(pred == k), 1))
    return float(np.mean(f1))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table(), "model string, split string, id long, grp int, y int, p array<double>")


@pytest.fixture(scope="module")
def adapted(rows):
    return A.adapted(rows, K, SOURCE, grid=(0.1, 10.0), folds=2).toPandas()


def em(p, source):
    now = np.array(source)
    for _ in range(200):
        q = p * now / source
        q /= q.sum(1, keepdims=True)
        new = q.mean(0)
        if np.abs(new - now).max() < 1e-8:
            return new
        now = new
    return now


def test_methods_are_fitted_on_train_rows_alone(adapted):
    assert set(adapted["method"]) == set(A.ROLES)
    assert (adapted.groupby(["model", "method"]).size() == 600).all()
    for model, own in adapted.groupby("model"):
        plain = own[own.method == "unchanged"].sort_values("id")
        p = np.stack(plain["p"])
        train = (plain["split"] == "train").to_numpy()
        seen = np.bincount(plain["y"][train], minlength=K) / train.sum()
        for method, priors in (("em_priors", em(p[train], SOURCE)), ("train_priors", seen)):
            want = p * priors / SOURCE
            want /= want.sum(1, keepdims=True)
            got = np.stack(own[own.method == method].sort_values("id")["p"])
            assert np.abs(got - want).max() < 1e-6, (model, method)
        y = plain["y"].to_numpy()
        loss = lambda name: -np.log(np.stack(own[own.method == name].sort_values("id")["p"])[train, y[train]]).mean()  # noqa: E731, B023
        assert loss("temperature") <= loss("unchanged") + 1e-9
        scaled = [np.exp(np.log(p[train]) / t) for t in np.exp(np.linspace(-1, 1, 201))]
        assert loss("temperature") <= min(-np.log((s / s.sum(1, keepdims=True))[np.arange(train.sum()), y[train]]).mean() for s in scaled) + 1e-6
        assert loss("calibrator") < loss("unchanged")
        assert np.allclose(np.stack(own["p"]).sum(1), 1)


def test_offsets_by_model_are_those_of_each_alone(spark, rows):
    both = {r.model: (r.o1, r.o2, round(r.macro_f1, 9)) for r in P.search_offsets(rows, K, by=("model",)).collect()}
    for m in ("a", "b"):
        one = P.search_offsets(rows.where(f"model = '{m}'"), K).first()
        assert both[m] == (one.o1, one.o2, round(one.macro_f1, 9))


def test_priors_by_model_are_those_of_each_alone(spark, rows):
    both = {r.model: r for r in P.priors_by(rows, SOURCE).collect()}
    for m in ("a", "b"):
        want, rounds, settled = P.estimate_priors(rows.where(f"model = '{m}'"), SOURCE)
        assert both[m].priors == pytest.approx(want, abs=1e-9) and (both[m].rounds, both[m].settled) == (rounds, settled)
    assert P.priors_by(rows.where("false"), SOURCE).count() == 0


def test_gains_have_the_spread_of_a_bootstrap_of_groups(spark, adapted):
    val = adapted[adapted["split"] == "val"].assign(pred=lambda f: [int(np.argmax(p)) for p in f["p"]])
    frame = spark.createDataFrame(val[["model", "method", "grp", "y", "pred"]])
    got = {(r.model, r.method): r for r in A.gains(frame, K, 400, 3).collect()}
    assert got["a", "unchanged"].gain_low == got["a", "unchanged"].gain_high == 0
    rng = np.random.default_rng(0)
    for model in ("a", "b"):
        own = {m: f.sort_values("id") for m, f in val[val.model == model].groupby("method")}
        base, other = own["unchanged"], own["train_priors"]
        y, grp = base["y"].to_numpy(), base["grp"].to_numpy()
        a, b = base["pred"].to_numpy(), other["pred"].to_numpy()
        r = got[model, "train_priors"]
        assert r.draws == 400 and r.gain == pytest.approx(macro(y, b) - macro(y, a))
        members = [np.flatnonzero(grp == g) for g in np.unique(grp)]
        drawn = []
        for _ in range(1000):
            at = np.concatenate([members[g] for g in rng.integers(len(members), size=len(members))])
            drawn.append(macro(y[at], b[at]) - macro(y[at], a[at]))
        low, high = np.quantile(drawn, [0.025, 0.975])
        wide = high - low
        assert abs(r.gain_low - low) < 0.2 * wide and abs(r.gain_high - high) < 0.2 * wide


def test_the_table_ranks_methods_by_val(rows):
    out = A.adaptation_table(rows, K, SOURCE, 50, 1, grid=(1.0,), folds=2).toPandas().sort_values("place")
    assert list(out["place"]) == list(range(1, 15)) and (out["val_n"] == 200).all() and (out["train_n"] == 400).all()
    assert out["val_macro_f1"].round(9).is_monotonic_decreasing
    assert set(out["role"]) == set(A.ROLES.values())


def test_geometry_report(spark):
    rng = np.random.default_rng(2)

    def boxes(n, first):
        out = []
        for k in range(n):
            y = int(rng.choice(4, p=[0.4, 0.2, 0.2, 0.2]))
            x = rng.normal(size=4)
            x[y] += 2
            out.append((first + k, y, x.tolist()))
        return spark.createDataFrame(out, "id long, y int, features array<double>")

    development, test, external = boxes(300, 0), boxes(200, 1000), boxes(150, 2000)
    merged = external.selectExpr("id", "least(y, 2) AS y", "features")
    out = {(r.candidate, r.domain): r for r in Z.geometry_report(development, test, merged, 4, [[0], [1], [2, 3]], 300, 7).collect()}
    own = out["geometry", "source"]
    head = Z.fit_head(development, 4, balanced=True)
    got = head.predict(test).toPandas()
    y, pred = got["y"].to_numpy(), np.array([np.argmax(p) for p in got["p"]])
    f1 = lambda y, pred, k: np.mean([2 * np.sum((y == c) & (pred == c)) / max(np.sum(y == c) + np.sum(pred == c), 1) for c in range(k)])
    assert own.n == 200 and own.accuracy == pytest.approx(np.mean(y == pred)) and own.macro_f1 == pytest.approx(f1(y, pred, 4))
    drawn = []
    for _ in range(1000):
        at = np.concatenate([rng.choice(np.flatnonzero(y == c), size=np.sum(y == c)) for c in range(4)])
        drawn.append(f1(y[at], pred[at], 4))
    low, high = np.quantile(drawn, [0.025, 0.975])
    assert abs(own.low - low) < 0.2 * (high - low) and abs(own.high - high) < 0.2 * (high - low)
    assert 0.5 < own.oof_macro_f1 < 1
    far = head.predict(merged).toPandas()
    p = np.stack(far["p"])
    p = np.stack([p[:, 0], p[:, 1], p[:, 2] + p[:, 3]], axis=1)
    told = out["geometry", "external"]
    assert told.accuracy == pytest.approx(np.mean(p.argmax(1) == far["y"])) and told.log_loss == pytest.approx(-np.log(p[np.arange(150), far["y"]]).mean())
    most = out["majority", "source"]
    assert most.accuracy == pytest.approx(np.mean(y == 0)) and most.log_loss is None and most.oof_macro_f1 is None
