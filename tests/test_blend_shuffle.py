"""Blends: what is shuffled doesn't grow with the fusions."""

import pytest

from cohortspark.operators import metrics as M
from cohortspark.operators import probs as P
from cohortspark.operators import reports as R

ROWS = [("a", 1, 0, [0.6, 0.4]), ("b", 1, 0, [0.2, 0.8]), ("a", 2, 1, [0.3, 0.7]), ("c", 3, None, [0.5, 0.5]), ("a", 4, 1, [None, 0.7]), ("b", 4, 1, [0.5, None])]


@pytest.fixture(scope="module")
def preds(spark):
    return spark.createDataFrame(ROWS, "model string, id long, y int, p array<double>")


def test_fusions_meet_rows_after_the_shuffle(spark, preds):
    weights = spark.createDataFrame([("x", "a", 0.25), ("x", "b", 0.75), ("y", "b", 1.0)], "fusion string, model string, w double")
    out = P.blend(preds, weights, k=2)
    got = {(r.fusion, r.id): [None if v is None else round(v, 12) for v in r.p] for r in out.collect()}
    assert got == {("x", 1): [0.3, 0.7], ("x", 2): [0.075, 0.175], ("x", 4): [0.375, 0.175], ("y", 1): [0.2, 0.8], ("y", 4): [0.5, None]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate [id")  # upper nodes stand first


def test_scores_of_one_count_are_those_of_the_rows(spark, preds):
    rows = preds.where("id < 3")
    grid = P.weight_grid(spark, ["a", "b"], 2)
    got = {r.fusion: r for r in P.select_blend(rows, grid, 2).collect()}
    blended = M.with_prediction(P.blend(rows, grid.withColumnRenamed("weight_id", "fusion"), k=2))
    for r in M.log_loss(blended, ("fusion",)).join(M.macro_f1(blended, 2, ("fusion",)), "fusion").collect():
        assert abs(got[r.fusion].log_loss - r.log_loss) < 1e-8 and abs(got[r.fusion].macro_f1 - r.macro_f1) < 1e-8


def test_leave_one_out_joins_no_rows(preds):
    out = {r.omitted: r for r in R.leave_one_out(preds.where("id < 3"), ["a", "b"], 2).collect()}
    assert out["none"].agreement == 1.0 and out["none"].accuracy == 0.5  # 0.4, 0.6 is class 1 of label 0
    assert out["b"].accuracy == 1.0 and out["b"].agreement == 0.5 and out["a"].accuracy == 0.0 and out["a"].agreement == 1.0
