"""Ranks, running sums and what is built on them, against brute force, also where one value holds most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import fields as B
from cohortspark.operators import gates as G
from cohortspark.operators import metrics as M
from cohortspark.operators import pairs as D
from cohortspark.operators import probs as P
from cohortspark.operators import splits as J
from cohortspark.operators.order import positions, running
from cohortspark.operators.select import gated


@pytest.fixture(scope="module")
def skewed():
    """Two models of 470 and 31 rows; nine tenths of the scores are one value."""
    rng = np.random.default_rng(5)
    frames = []
    for model, n in (("a", 470), ("b", 31)):
        p = rng.dirichlet(np.ones(3), n)
        p[rng.random(n) < 0.9] = (0.5, 0.25, 0.25)
        frames.append(pd.DataFrame({"model": model, "id": rng.permutation(n), "y": rng.integers(0, 3, n), "p": p.tolist()}))
    return pd.concat(frames)


@pytest.fixture(scope="module")
def preds(spark, skewed):
    return M.with_prediction(spark.createDataFrame(skewed, "model string, id long, y int, p array<double>"))


def test_ranks_and_sums_are_exact(skewed, preds):
    out = M.ranked(preds).toPandas()
    assert len(out) == len(skewed)
    for model, own in out.groupby("model"):
        x = own.sort_values(["conf", "id"], ascending=[False, True])
        assert x["rank"].tolist() == list(range(1, len(x) + 1)) and (x["n_all"] == len(x)).all()
        assert x["errors_so_far"].tolist() == (x["y"] != x["pred"]).cumsum().tolist()


def test_no_window_sees_a_group(preds):
    plan = running(preds, ["model"], [F.desc("conf"), F.asc("id")], {"rank": F.lit(1)})._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if "Window [" in line)


def test_adaptive_calibration_takes_rising_confidence(skewed, preds):
    got = {r.model: r.adaptive_ece for r in M.adaptive_calibration_error(preds).collect()}
    for model, own in skewed.sort_values("id").groupby("model"):
        p = np.array(own["p"].tolist())
        conf, hit = p.max(axis=1), p.argmax(axis=1) == own["y"].to_numpy()
        bins = np.array_split(np.argsort(conf, kind="stable"), 15)
        assert got[model] == pytest.approx(sum(len(b) / len(p) * abs(hit[b].mean() - conf[b].mean()) for b in bins if len(b)))


def test_areas_and_distances_are_brute_force(skewed, preds):
    got = {r.model: r for r in M.macro_auc(preds).collect()}
    for model, own in skewed.groupby("model"):
        p, y = np.array(own["p"].tolist()), own["y"].to_numpy()
        areas, precision = [], []
        for k in range(3):
            pos, neg = p[y == k, k], p[y != k, k]
            areas.append(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)))
            cuts = np.unique(p[:, k])[::-1]
            hits = np.array([(pos >= c).sum() for c in cuts])
            precision.append((np.diff(hits, prepend=0) * hits / np.array([(p[:, k] >= c).sum() for c in cuts])).sum() / len(pos))
        assert got[model].macro_auroc == pytest.approx(np.mean(areas)) and got[model].macro_average_precision == pytest.approx(np.mean(precision))
    sides = preds.withColumn("side", F.col("id") % 2 == 0)
    ks = {r.model: r.ks for r in M.ks_statistic(sides, "conf", "side", ["model"]).collect()}
    for model, own in skewed.groupby("model"):
        conf, side = np.array(own["p"].tolist()).max(axis=1), own["id"].to_numpy() % 2 == 0
        assert ks[model] == pytest.approx(max(abs((conf[side] <= c).mean() - (conf[~side] <= c).mean()) for c in conf))


def test_places_without_groups_and_of_null_groups(spark):
    rows = spark.createDataFrame([(None, 3), (None, 1), ("x", 2), ("x", 2)], "g string, v int")
    assert sorted((r.g or "", r.at) for r in positions(rows, ["g"], [F.asc("v")], "at").collect()) == [("", 1), ("", 2), ("x", 1), ("x", 2)]
    assert sorted(r.at for r in positions(rows, (), [F.asc("v")], "at").collect()) == [1, 2, 3, 4]
    assert positions(rows.limit(0), ["g"], [F.asc("v")], "at").count() == 0


def test_folds_are_even_within_labels(preds):
    out = J.stratified_folds(preds, "y", 4, 7).toPandas()
    counts = out.groupby(["y", "fold"]).size().unstack(fill_value=0)
    assert (counts.max(axis=1) - counts.min(axis=1) <= 1).all() and len(out) == preds.count()


def test_blends_are_selected_by_brute_force(spark, skewed):
    own = skewed[skewed["model"] == "a"].sort_values("id").head(31)
    other = skewed[skewed["model"] == "b"].sort_values("id").assign(y=own["y"].to_numpy())
    frame = pd.concat([own, other])
    table = spark.createDataFrame(frame, "model string, id long, y int, p array<double>")
    out = P.select_blend(table, P.weight_grid(spark, ["a", "b"], 4), 3).orderBy("place").toPandas()
    y, pa, pb = own["y"].to_numpy(), *(np.array(x["p"].tolist()) for x in (own, other))
    best = None
    for k in range(5):
        p = k / 4 * pa + (1 - k / 4) * pb
        pred = p.argmax(axis=1)
        f1 = np.mean([2 * ((y == c) & (pred == c)).sum() / max((y == c).sum() + (pred == c).sum(), 1) for c in range(3)])
        loss = -np.log(p[np.arange(len(y)), y]).mean()
        row = out[out["fusion"] == f"{k}|{4 - k}"].iloc[0]
        assert row["macro_f1"] == pytest.approx(f1, abs=1e-8) and row["log_loss"] == pytest.approx(loss, abs=1e-8)
        best = min(best or (9,), (-round(f1, 9), round(loss, 9), f"{k}|{4 - k}"))
    assert out.iloc[0]["fusion"] == best[-1]


def test_temperature_is_the_least_loss(preds):
    got = P.fit_temperature(preds.where("model = 'a'")).first()
    rows = preds.where("model = 'a'").toPandas()
    z, y = np.log(np.array(rows["p"].tolist())), rows["y"].to_numpy()

    def loss(t):
        q = np.exp(z / t)
        return -np.log((q / q.sum(axis=1, keepdims=True))[np.arange(len(y)), y]).mean()

    grid = np.exp(np.linspace(-4, 4, 4001))
    assert got.nll == pytest.approx(min(map(loss, grid)), abs=1e-6) and loss(got.temperature) == pytest.approx(got.nll)


def test_priors_settle_where_the_mean_is_the_prior(preds):
    rows = preds.where("model = 'a'")
    priors, _, settled = P.estimate_priors(rows, [0.4, 0.3, 0.3], rounds=2000)
    p = np.array(rows.toPandas()["p"].tolist()) * (np.array(priors) / np.array([0.4, 0.3, 0.3]))
    assert settled and (p / p.sum(axis=1, keepdims=True)).mean(axis=0) == pytest.approx(priors, abs=1e-6)


def test_gates_name_each_check(spark):
    good = dict(comparison="c", macro_gain=0.02, class_gain=0.0, nll_increase=0.0, brier_increase=0.0, rescued=9, harmed=2, net=7, runs=3, least_run_gain=0.01, least_run_net=1, low=0.001, p_holm=0.01)
    bad = {"gain": dict(macro_gain=0.0), "net": dict(net=0), "interval": dict(low=0.0), "holm": dict(p_holm=0.05), "class_drop": dict(class_gain=-0.03), "nll": dict(nll_increase=0.03), "brier": dict(brier_increase=0.02), "runs_gain": dict(least_run_gain=0.0), "runs_net": dict(least_run_net=0)}
    rows = spark.createDataFrame([good | {"comparison": name} | change for name, change in bad.items()] + [good])
    locked = {r.comparison: r.failed for r in gated(rows, G.locked_checks()).collect()}
    assert locked == {"c": ""} | {n: n for n in bad}
    early = {r.comparison: r.failed for r in gated(rows, G.development_checks()).collect()}
    assert early == {"c": "", "interval": "", "holm": ""} | {n: n for n in bad if n not in ("interval", "holm")}
    assert gated(rows.where("comparison = 'c'").withColumn("runs", F.lit(2)), G.development_checks()).first().failed == "runs_gain,runs_net"


def test_pose_of_a_box(spark):
    points = [(10 + k, 20 + 2 * k, k % 3) for k in range(17)]
    rows = spark.createDataFrame([(10, 20, 26, 52, points)], "x0 int, y0 int, x1 int, y1 int, points array<struct<x:int,y:int,v:int>>")
    got = rows.select(B.pose("points", [(1, 2), (0, 1)]).alias("f")).first().f
    x, y = ([(k / 16 if k % 3 else 0.0) for k in range(17)], [(2 * k / 32 if k % 3 else 0.0) for k in range(17)])
    base = [v for k in range(17) for v in (x[k], y[k], float(k % 3 > 0), float(k % 3 == 2))]
    bones = [x[2] - x[1], y[2] - y[1], np.hypot(x[2] - x[1], y[2] - y[1]), 1.0, 0.0, 0.0, 0.0, 0.0]
    n = sum(k % 3 > 0 for k in range(17))
    assert got == pytest.approx([*base, *bones, n / 17, sum(k % 3 == 2 for k in range(17)) / 17, sum(x) / n, sum(y) / n])


def test_files_that_fail_are_excluded_first(spark):
    rows = spark.createDataFrame([(1, 100, 80, 100, 80, True), (2, 100, 80, 90, 80, True), (3, 100, 80, 100, 80, False), (4, 100, 80, None, None, False)], "k int, w int, h int, file_w int, file_h int, decode_ok boolean")
    out = {r.k: r for r in B.inspected(rows.withColumns({"xmin": F.lit(95), "ymin": F.lit(0), "xmax": F.lit(120), "ymax": F.lit(50)})).collect()}
    assert [out[k].exclusion_reason for k in (1, 2, 3, 4)] == ["", "invalid_person_box", "decode_failure", "decode_failure"]
    assert [out[k].dimension_match for k in (1, 2, 3, 4)] == [True, False, True, False] and out[1].x1 == 100


def test_hashed_neighbours_find_nearly_all(spark):
    """Near copies of 300 vectors among 900: at least nine tenths of the exact pairs, and no other pair."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.02, rng.normal(size=(300, 16))])
    rows = [(k, "train" if k < 300 else "test", [float(v) for v in row]) for k, row in enumerate(x)] + [(900, "test", [0.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, split string, features array<double>")
    exact = {tuple(p) for p in D.embedding_neighbours(frame.where("vec_id < 900"), 0.985, 5).select("left_id", "right_id").collect()}
    found = {tuple(p) for p in D.hashed_neighbours(frame, 0.985, 5).select("left_id", "right_id").collect()}
    assert len(exact) >= 300 and found <= exact and len(found) >= 0.9 * len(exact)
