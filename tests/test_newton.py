"""Heads fitted side by side against Spark's own fits."""

import numpy as np
import pytest

from cohortspark.operators import heads as Z
from cohortspark.operators import metrics as M
from cohortspark.operators import newton as W
from cohortspark.sources.tables import materialize

K = 3


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for k in range(400):
        y = int(rng.choice(K, p=[0.2, 0.3, 0.5]))
        x = rng.normal(size=3) * [1, 50, 0] + [y, 1000, 7]
        out.append(("m" if k % 4 else "other", k % 2, y, 1 + k % 3, x.tolist()))
    return materialize(spark.createDataFrame(out, "`group` string, fold int, y int, n long, features array<double>"))


def test_fits_side_by_side_are_those_of_single_heads(spark, rows):
    heads = W.fit_heads(rows, K, [(g, c, b, 1) for g in ("m", "other") for c in (0.1, 10.0) for b in (False, True)])
    assert len(heads) == 16  # each without the fold, and on all rows
    every = rows.selectExpr("*", "explode(sequence(1, n)) AS copy")
    for key in [("m", 0.1, True, 1), ("other", 10.0, False, -1)]:
        g, c, balanced, out = key
        own = every.where(f"`group` = '{g}' AND fold <> {out}")
        one = Z.fit_head(own, K, c=c, balanced=balanced).predict(own, "p")
        both = heads[key].predict(one, "q").selectExpr("transform(arrays_zip(p, q), z -> abs(z.p - z.q)) AS gap").selectExpr("max(array_max(gap)) AS gap").first().gap
        assert both < 1e-3


def test_losses_of_held_out_folds_in_one_pass(rows):
    heads = W.fit_heads(rows, K, [("m", 1.0, False, k) for k in (0, 1)])
    losses = W.held_out_losses(rows, heads, M.EPS)
    own = [r for r in rows.where("`group` = 'm'").collect()]
    total = loss = 0
    for r in own:
        h = heads["m", 1.0, False, r.fold]
        z = h.weights @ np.array(r.features) + h.bias
        loss += r.n * (np.log(np.exp(z - z.max()).sum()) + z.max() - z[r.y])
        total += r.n
    assert abs(losses["m", 1.0, False] - loss / total) < 1e-9


def test_a_separable_or_missing_class_ends(spark):
    rows = materialize(spark.createDataFrame([("", 0, k % 2, 1, [float(k % 2)]) for k in range(20)], "`group` string, fold int, y int, n long, features array<double>"))
    head = W.fit_heads(rows, K, [("", 1e6, True, -1)])["", 1e6, True, -1]
    p = np.array([r.p for r in head.predict(rows).collect()])
    assert np.isfinite(p).all() and (p[:, 2] < 1e-6).all() and head.iterations <= 100


def test_calibrators_of_all_models_share_their_passes(spark):
    rng = np.random.default_rng(6)
    out = [(m, k % 17, int(rng.integers(K)), (rng.integers(1, 5, K) / 10).tolist()) for m in ("a", "b") for k in range(300)]
    preds = spark.createDataFrame(out, "model string, grp int, y int, p array<double>")
    both = Z.fit_calibrators(preds, K, [0.1, 10.0], 2, (False, True))
    assert set(both) == {(m, b) for m in ("a", "b") for b in (False, True)}
    one, c = Z.fit_calibrator(preds.where("model = 'b'"), K, [0.1, 10.0], 2, True)
    assert c == both["b", True][1] and np.allclose(one.weights, both["b", True][0].weights, atol=1e-6)
