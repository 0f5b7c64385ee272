"""Operators on small tables with known results, and on what they must reject."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.functions import fields as B
from cohortspark.operators import checks as C
from cohortspark.operators import components as E
from cohortspark.operators import heads as Z
from cohortspark.operators import metrics as M
from cohortspark.operators import pairs as D
from cohortspark.operators import probs as P
from cohortspark.operators import reports as R
from cohortspark.operators import resample as H
from cohortspark.operators import select as L
from cohortspark.operators import splits as J


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def six(spark):
    """Six rows, three classes, near-certain and right."""
    sure = lambda y: [0.98 if k == y else 0.01 for k in range(3)]
    return M.with_prediction(table(spark, [("m", k, k // 2, k % 3, sure(k % 3)) for k in range(6)], "model string, id long, grp long, y int, p array<double>"))


def test_metrics_of_perfect_predictions(six):
    assert M.accuracy(six).first().accuracy == 1
    assert M.macro_f1(six, 3).first().macro_f1 == 1
    assert M.log_loss(six).first().log_loss == pytest.approx(-math.log(0.98))
    assert M.aurc(six).first().aurc == 0
    assert M.macro_auc(six).first().macro_auroc == 1


def test_confusion_keeps_empty_cells(six):
    assert M.confusion(six.where("y < 2"), 3).count() == 9


def test_two_macro_rules(six):
    cells = M.confusion(six.where("y < 2"), 3)
    assert M.macro(M.per_class(cells)).first().macro_f1 == pytest.approx(2 / 3)
    assert M.macro(M.per_class(cells), over="observed").first().macro_f1 == 1


def test_selective_points(spark):
    rows = [("m", k, y, p) for k, (y, p) in enumerate([(0, [0.9, 0.1]), (1, [0.2, 0.8]), (0, [0.4, 0.6]), (1, [0.55, 0.45])])]
    preds = M.with_prediction(table(spark, rows, "model string, id long, y int, p array<double>"))
    out = {r.coverage: r for r in M.risk_coverage(preds, [1.0, 0.5]).collect()}
    assert out[0.5].retained == 2 and out[0.5].accuracy == 1 and out[1.0].risk == 0.5


def test_rank_of_ties_goes_by_id(spark):
    rows = [("m", k, 0, 0, 0.5) for k in range(50)]
    out = M.ranked(table(spark, rows, "model string, id long, y int, pred int, conf double")).orderBy("id").collect()
    assert [r.rank for r in out] == list(range(1, 51))


def test_spearman_of_constant_is_null(spark):
    assert M.spearman(table(spark, [(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first().spearman is None


def test_components_of_a_long_path_and_loops(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 500), (700, 600), (600, 700), (None, 3)]
    out = {r.id: r.component for r in E.connected_components(table(spark, edges, "left_id long, right_id long")).collect()}
    assert {out[k] for k in range(201)} == {0} and out[500] == 500 and out[700] == 600


def test_audit_of_groups(spark):
    rows = table(spark, [(1, "train"), (2, "test"), (3, "train"), (4, "train"), (5, "val")], "id long, split string")
    edges = table(spark, [(1, 2), (3, 4)], "left_id long, right_id long")
    out = E.audit_groups(rows, edges, table(spark, [(4,)], "id long")).where("NOT quarantined").collect()
    assert [(r.id, r.split) for r in out] == [(5, "val")]


def test_near_hashes_find_every_pair(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    rows = [(k, ("train", "test")[k % 2], (v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8)))) - (1 << 63)) for k, v in enumerate(base * 6)]
    got = {(r.left_id, r.right_id): r.distance for r in D.near_hash(table(spark, rows, "id long, split string, h long"), 6).collect()}
    want = {(a[0], b[0]): d for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and (d := bin((a[2] ^ b[2]) & (2**64 - 1)).count("1")) <= 6}
    assert got == want


def test_constant_vectors_correlate_only_if_equal(spark):
    rows = table(spark, [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])], "id long, v array<double>")
    pairs = table(spark, [(1, 2), (1, 3)], "left_id long, right_id long")
    assert {r.right_id: r.correlation for r in D.enriched(pairs, rows, "id", "v").collect()} == {2: 1.0, 3: 0.0}


def test_neighbours_never_share_a_split(spark):
    rows = [(1, "train", [1.0, 0.0]), (2, "test", [1.0, 0.001]), (3, "train", [1.0, 0.0]), (4, "test", [0.0, 1.0])]
    out = D.embedding_neighbours(table(spark, rows, "vec_id long, split string, features array<double>"), 0.99, 2).collect()
    assert {(r.left_id, r.right_id) for r in out} == {(1, 2), (2, 3)}


def test_checked_join_rejects_repeated_keys(spark):
    left = table(spark, [(1,)], "k long")
    with pytest.raises(Exception, match="repeats"):
        D.left_checked(left, table(spark, [(1, 2), (1, 3)], "k long, v long"), "k").collect()


def test_enforce_names_the_violation(spark):
    with pytest.raises(ValueError, match="ids"):
        C.enforce(C.repeated(table(spark, [(1,), (1,)], "id long"), ["id"]), "ids")
    C.enforce(C.repeated(table(spark, [(1,), (2,)], "id long"), ["id"]), "ids")


@pytest.mark.parametrize("p,reason", [([0.5, 0.6], "sum"), ([float("nan"), 1.0], "range"), ([-0.1, 1.1], "range"), (None, "missing"), ([], "missing")])
def test_bad_probabilities(spark, p, reason):
    assert P.probability_violations(table(spark, [(1, 0, p)], "id long, y int, p array<double>")).first().reason == reason


def test_names_and_tokens(spark):
    rows = table(spark, [("[cat]_Getty_P123_x.jpg",), (" [dog]_getty_p9_x.jpg ",), ("getty_p1_y.jpg",)], "n string").select(B.source_name("n").alias("n")).collect()
    assert rows[0] == rows[1] != rows[2]


def test_boxes(spark):
    box = table(spark, [(5, 10, 55, 60, 100, 80)], "x0 int, y0 int, x1 int, y1 int, w int, h int")
    assert tuple(box.select(*B.context_box(0.1)).first()) == (0, 5, 60, 65)


def test_quartiles_need_distinct_borders(spark):
    with pytest.raises(Exception, match="coincide"):
        B.quartile(table(spark, [(1.0,)] * 8, "v double"), "v").collect()


def test_holm(spark):
    rows = table(spark, [("a", 0, 0.01), ("b", 0, 0.04), ("c", 0, 0.03)], "name string, family int, p double")
    assert [round(r.p_holm, 9) for r in L.holm(rows, ["family"]).orderBy("name").collect()] == [0.03, 0.06, 0.06]


def test_gate_fails_on_one_limit_and_on_unknowns(spark):
    rows = table(spark, [(0.9, 0.1), (0.9, 0.9), (0.9, None)], "f double, l double")
    out = L.gated(rows, {"f": F.col("f") > 0.5, "l": F.col("l") < 0.5}).collect()
    assert [r.failed for r in out] == ["", "l", "l"]


def test_seeds_must_be_complete(spark):
    rows = table(spark, [("ref", 1, 0.5), ("ref", 2, 0.5), ("a", 1, 0.6), ("a", 2, 0.5), ("b", 1, 0.6)], "model string, seed int, score double")
    out = {r.model: r for r in L.seed_sensitivity(rows, [1, 2], ["model"]).collect()}
    assert out["a"].all_positive is False and out["b"].problem == "2" and out["b"].mean_gain is None


def test_blends(spark):
    grid = P.weight_grid(spark, ["a", "b", "c"], 2)
    assert grid.select("weight_id").distinct().count() == 6
    rows = table(spark, [(m, k, k % 2, p) for m, ps in (("a", ([0.9, 0.1], [0.6, 0.4])), ("b", ([0.4, 0.6], [0.1, 0.9]))) for k, p in enumerate(ps)], "model string, id long, y int, p array<double>")
    best = P.select_blend(rows, P.weight_grid(spark, ["a", "b"], 2), 2).where("place = 1").first()
    assert best.fusion == "1|1" and best.macro_f1 == 1


def test_temperature_and_priors(spark, six):
    p = six.select(P.with_temperature("p", 1.0).alias("q"), "p").first()
    assert p.q == pytest.approx(p.p)
    rows = table(spark, [([0.9, 0.05, 0.05],)] * 60 + [([0.05, 0.9, 0.05],)] * 30 + [([0.05, 0.05, 0.9],)] * 10, "p array<double>")
    priors, _, settled = P.estimate_priors(rows, [1 / 3] * 3)
    assert settled and priors[0] > 0.6 and priors[2] < 0.1 and sum(priors) == pytest.approx(1)


@pytest.mark.parametrize("classes,shift", [(3, 0.0), (5, 0.0), (3, 2.2)])
def test_offsets_are_the_best_of_the_whole_grid(spark, classes, shift):
    """Against all 101 x 101 offsets one by one; scores of few values give ties, and a shift puts the best beyond 1.75."""
    rng = np.random.default_rng(classes)
    y = rng.integers(0, classes, 60)
    s = rng.integers(1, 6, (60, classes)) + 4.0 * (np.arange(classes) == y[:, None])
    s[:, 1] *= np.exp(-shift)
    p = s / s.sum(axis=1, keepdims=True)
    grid, z, best = np.linspace(-2.5, 2.5, 101), np.log(p), None
    for a in grid:
        for b in grid:
            pred = (z + np.array([0, a, b] + [0] * (classes - 3))).round(12).argmax(axis=1)
            f1 = [2 * ((pred == c) & (y == c)).sum() / max((pred == c).sum() + (y == c).sum(), 1) for c in range(classes)]
            rank = (-round(sum(f1) / classes, 12), round(a * a + b * b, 9), a, b)
            best = min(best or rank, rank)
    rows = [(k, int(y[k]), p[k].tolist()) for k in range(60)]
    out = P.search_offsets(table(spark, rows, "id long, y int, p array<double>"), classes).first()
    assert (-out.macro_f1, out.o1, out.o2) == pytest.approx((best[0], best[2], best[3]), abs=1e-9)
    assert shift == 0 or out.o1 > 1.75


def test_identical_models_have_no_difference(spark):
    pairs = table(spark, [(k, k // 3, k % 3, (k * k) % 3, (k * k) % 3) for k in range(60)], "id long, grp long, y int, pred_a int, pred_b int")
    out = H.interval(H.deltas(H.cluster_draws(pairs, 30, 1), 3)).first()
    assert (out.point, out.low, out.high, out.p_two_sided) == (0, 0, 0, 1)


def test_groups_move_together_in_the_randomization(spark):
    rows = [(0, "a", 0, 1, 0), (1, "a", 1, 0, 1), (2, "b", 0, 1, 0), (3, "b", 1, 0, 1)]
    schema = "id long, grp string, y int, pred_a int, pred_b int"
    grouped = H.randomization(table(spark, rows, schema), 2, 999, 4).first().p
    single = H.randomization(table(spark, [(i, str(i), *r) for i, _, *r in rows], schema), 2, 999, 4).first().p
    assert 0.45 < grouped < 0.55 and 0.09 < single < 0.16


def test_bootstrap_is_repeatable(spark):
    pairs = table(spark, [(k, k % 7, k % 3, (k + k // 5) % 3, k % 3 if k % 4 else 0) for k in range(90)], "id long, grp long, y int, pred_a int, pred_b int")
    one, two = (H.interval(H.deltas(H.cluster_draws(pairs.repartition(n), 40, 1), 3)).first() for n in (1, 5))
    assert one == two and one.point > 0
    rows = H.stratified_bootstrap(pairs, 3, 50, 1).toPandas()
    assert (rows["delta"] > 0).mean() > 0.9


def test_missing_values_are_counted(spark):
    rows = table(spark, [(k, float("nan") if k == 3 else None if k == 4 else float(k)) for k in range(6)], "id long, v double")
    out = H.mean_draws(rows, "v", 5, 1).where("draw = -1").first()
    assert out.excluded == 2 and out.mean == pytest.approx((0 + 1 + 2 + 5) / 4)


def test_folds_and_samples(spark):
    rows = table(spark, [(k, k // 3, "abc"[(k // 3) % 3], "train") for k in range(90)], "id long, grp long, y string, split string")
    folds = J.stratified_group_folds(rows, "grp", "y", 3)
    joined = rows.join(folds, "grp")
    assert C.crossing(joined, "grp", "fold").count() == 0 and joined.groupBy("fold").agg(F.count_distinct("y").alias("n")).where("n < 3").count() == 0
    sizes = [r["count"] for r in J.stratified_folds(rows, "y", 5, 1).groupBy("y", "fold").count().collect()]
    assert max(sizes) - min(sizes) == 0
    nested = J.nested_subsets(rows, "y", [9, 30], 2)
    small, large = ({r.id for r in nested.where(f"size = {s}").collect()} for s in (9, 30))
    assert small < large and len(small) == 9
    assert {r.id for r in J.balanced_cohort(rows, "y", 4, 7).collect()} == {r.id for r in J.balanced_cohort(rows.repartition(7), "y", 4, 7).collect()}
    weights = [r.weight for r in J.class_weights(rows.where("id < 30 OR y <> 'a'"), "y").collect()]
    assert sum(weights) / len(weights) == pytest.approx(1)
    with pytest.raises(ValueError):
        J.balanced_strata(rows, ["y"], 10, 1)
    taken = J.few_shot(rows, "grp", "y", [1], 2, 3)
    per = taken.join(rows, "grp").groupBy("repeat", "y").count()
    assert per.count() == 6 and taken.groupBy("repeat").count().where("count > 3").count() == 0


def test_localisation(spark):
    values = [0.0] * 16
    values[0] = values[1] = values[4] = values[5] = 1.0
    values[10] = 6.0
    rows = table(spark, [(1, values, 0, 0, 2, 2)], "id long, m array<double>, x0 int, y0 int, x1 int, y1 int")
    out = R.localisation(rows, "m", 4, ("x0", "y0", "x1", "y1"), "id").first()
    assert out.mass == pytest.approx(0.4) and out.lift == pytest.approx(1.6) and out.pointing is False


def test_curve_needs_a_growing_grid(spark):
    rows = table(spark, [("a", 0.0, 1.0), ("a", 1.0, 0.0), ("b", 0.0, 1.0), ("b", 0.0, 0.0)], "k string, x double, y double")
    assert {r.k: r.area for r in M.curve_area(rows, ("k",)).collect()} == {"a": 0.5, "b": None}


def test_replay_finds_each_change(spark):
    a = table(spark, [("m", "f1", 0.5), ("m", "n", 3.0)], "model string, metric string, value double")
    b = table(spark, [("m", "f1", 0.5 + 1e-6), ("m", "acc", 1.0)], "model string, metric string, value double")
    assert {r.problem for r in R.replay(a, b, ["model", "metric"]).collect()} == {"changed", "missing", "extra"}
    assert R.replay(a, a, ["model", "metric"]).count() == 0
    with pytest.raises(Exception, match="negative"):
        R.rescored(table(spark, [("m", 0, 0, -1)], "model string, y int, pred int, n long"), ["model"]).collect()


def test_heads_learn_separable_classes(spark):
    import random

    rng = random.Random(2)
    rows = [(k, k // 3, k % 3, "train" if k % 5 else "test", [rng.gauss(3.0 * (j == k % 3), 1) for j in range(4)]) for k in range(150)]
    x = table(spark, rows, "id long, grp long, y int, split string, features array<double>")
    out = M.with_prediction(Z.cross_fit(x, 3, 2))
    assert out.count() == 150 and M.accuracy(out, ()).first().accuracy > 0.85
    assert M.accuracy(M.with_prediction(Z.fit_factorised(x)(x)), ()).first().accuracy > 0.85
