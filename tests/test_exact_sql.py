"""Values in which Spark's own functions differ from SQL: halves that are none in doubles, correlations of constant vectors."""

import math

import duckdb

from cohortspark.functions import fields as B
from cohortspark.operators import pairs as D


def test_rounding_is_that_of_sql(spark):
    values = [a / 2 / b for a in range(1, 800, 7) for b in (200, 320, 448, 576, 599)] + [-333 / 640, 0.5, 2.5e-6, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(B.rounded("v", 6)).collect()]
    c = duckdb.connect()
    want = [c.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]
    assert got == want
    boxes = spark.createDataFrame([(333 / 2 / 320,)], "v double").select(B.rounded("v", 6)).first()[0]
    assert boxes == c.execute("SELECT round(CAST(333 AS DOUBLE) / 2 / 320, 6)").fetchone()[0] == 0.520312


def test_correlations_of_constant_vectors_by_way(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 2.0]), (4, [3.0, 3.0]), (5, None), (6, [2.0, 4.0])], "id long, v array<double>")
    pairs = spark.createDataFrame([(1, 2, 0), (1, 3, 0), (1, 4, 0), (1, 5, 0), (3, 6, 0)], "left_id long, right_id long, distance int")
    told = lambda way: {(r.left_id, r.right_id): r.correlation for r in D.enriched(pairs, rows, "id", "v", constant=way).collect()}
    nan, one = told("nan"), told("one")
    assert all(math.isnan(nan[p]) for p in ((1, 2), (1, 3), (1, 4))) and nan[1, 5] is None and abs(nan[3, 6] - 1) < 1e-12
    assert one[1, 2] == 1.0 and one[1, 4] == 0.0 and math.isnan(one[1, 3]) and one[1, 5] is None
    sure = {(r.left_id, r.right_id) for r in D.confirmed(D.enriched(pairs, rows, "id", "v", constant="one"), 2, 0.95).collect()}
    assert sure == {(1, 2), (1, 3), (3, 6)}
