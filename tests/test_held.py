"""Expressions on arrays that are worked out once a row, and priors of groups by both ways."""

import pytest

from cohortspark.functions import fields as B
from cohortspark.operators import probs as P

ROWS = [("a", [0.7, 0.2, 0.1]), ("a", [0.7, 0.2, 0.1]), ("a", [0.2, 0.5, 0.3]), ("b", [0.1, 0.1, 0.8]), ("b", [0.3, 0.6, 0.1]), ("b", [0.3, 0.3, 0.4])]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_logs_of_a_row_are_taken_once(spark):
    df = spark.createDataFrame(ROWS, "model string, p array<double>")
    assert plan(df.select(P.softmax(P.centred_logs("p")).alias("q"))).lower().count("ln(") == 1
    assert plan(df.select(P.with_temperature("p", 1.7).alias("q"))).lower().count("ln(") == 1
    for (_, p), r in zip(ROWS, df.select(P.softmax(P.centred_logs("p")).alias("q")).collect(), strict=True):
        assert r.q == pytest.approx(p)


def test_points_of_a_pose_are_placed_once(spark):
    df = spark.createDataFrame([(0, 0, 10, 20, [(5, 10, 2), (1, 2, 0)])], "x0 int, y0 int, x1 int, y1 int, points array<struct<x:int,y:int,v:int>>")
    out = df.select(B.pose("points", [(0, 1)]).alias("f"))
    assert plan(out).split("\n")[0].count("points#") == 1
    assert out.first().f == [0.5, 0.5, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5, 0.5]


def test_priors_take_no_job_a_round(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "model string, p array<double>")
    context = spark.sparkContext
    context.setJobGroup("priors", "")
    got = {r.model: r for r in P.priors_by(df, [1 / 3] * 3).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("priors"))
    context.setJobGroup("others", "")
    assert max(r.rounds for r in got.values()) > jobs
    told = [{r.model: r for r in P.priors_by(df, [1 / 3] * 3, rounds=4).collect()}]
    monkeypatch.setattr(P, "FEW", 0)  # by passes over the table
    told.append({r.model: r for r in P.priors_by(df, [1 / 3] * 3, rounds=4).collect()})
    for m in "ab":
        a, b = (t[m] for t in told)
        assert a.priors == pytest.approx(b.priors) and (a.rounds, a.settled) == (b.rounds, b.settled) == (4, False)
