"""Registered queries: probabilities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortspark.functions.fields import rounded
from cohortspark.operators import metrics as M
from cohortspark.operators import probs as P
from cohortspark.plans.q_metrics import AUROC, r  # noqa: F401
from cohortspark.sources.fixtures import CLASSES as K
from cohortspark.sources.fixtures import PREDS, preds

MODELS = ["ref", "cand", "third"]


def ra(c: str = "p"):
    return F.transform(c, lambda v: rounded(v, 9)).alias(c)


def on(f):
    return lambda spark, sf: f(spark, preds(spark, sf))


FUSIONS = [("prior", "ref", 1.0), ("blend", "ref", 0.5), ("blend", "cand", 0.25), ("blend", "third", 0.25), ("pair", "cand", 0.6), ("pair", "third", 0.4)]


def fusions(spark):
    return spark.createDataFrame(FUSIONS, "fusion string, model string, w double")


WEIGHTS = "w(fusion, model, w) AS (VALUES " + ", ".join(f"('{f}', '{m}', CAST({w} AS DOUBLE))" for f, m, w in FUSIONS) + ")"
RP = "list_transform({0}, lambda v: round(v, 9))"
BLEND = "bl AS (SELECT fusion, id, y, [sum(w.w * p[1]), sum(w.w * p[2]), sum(w.w * p[3]), sum(w.w * p[4]), sum(w.w * p[5])] AS p FROM preds JOIN w USING (model) GROUP BY fusion, id, y)"
WIDE = f"WITH {PREDS}, wide AS (SELECT a.id, a.y, a.p AS pa, b.p AS pb, a.pred AS ka, b.pred AS kb FROM preds a JOIN preds b USING (id) WHERE a.model = 'ref' AND b.model = 'cand')"


def wide(p):
    return M.paired(p, "ref", "cand").select("id", "y", F.col("p_a").alias("pa"), F.col("p_b").alias("pb"))


JS = "list_sum(list_transform(range(1, 6), lambda k: CASE WHEN pa[k] > 0 THEN pa[k] * ln(pa[k] / ((pa[k] + pb[k]) / 2)) ELSE 0 END + CASE WHEN pb[k] > 0 THEN pb[k] * ln(pb[k] / ((pa[k] + pb[k]) / 2)) ELSE 0 END)) / 2"
_E = "-list_sum(list_transform({0}, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END))"
_M = "list_sort({0}, 'DESC')[1] - list_sort({0}, 'DESC')[2]"
_L = "list_transform({0}, lambda v: ln(least(greatest(v, 1e-6), 1 - 1e-6)))"

QUERIES = {
    "normalise_clipped": (
        on(lambda s, p: p.select("model", "id", P.normalised(F.transform("s", lambda v: (v - 3).cast("double")), 1e-12).alias("p")).select("model", "id", ra())),
        f"WITH {PREDS}, c AS (SELECT model, id, list_transform(s, lambda v: greatest(CAST(v - 3 AS DOUBLE), 1e-12)) AS q FROM preds) SELECT model, id, list_transform(q, lambda v: round(v / list_sum(q), 9)) AS p FROM c",
    ),
    "collapse_classes": (
        on(lambda s, p: p.select("model", "id", P.collapsed("p", [[0, 1], [2], [3, 4]]).alias("p")).select("model", "id", ra())),
        f"WITH {PREDS} SELECT model, id, {RP.format('[p[1] + p[2], p[3], p[4] + p[5]]')} AS p FROM preds",
    ),
    "weighted_blends": (
        on(lambda s, p: P.blend(p, fusions(s)).select("fusion", "id", "y", ra())),
        f"WITH {PREDS}, {WEIGHTS}, {BLEND} SELECT fusion, id, y, {RP.format('p')} AS p FROM bl",
    ),
    "fusion_accuracy": (
        on(lambda s, p: r(M.accuracy(M.with_prediction(P.blend(p, fusions(s)).select("fusion", "id", "y", F.transform("p", lambda v: rounded(v, 9)).alias("p"))), ("fusion",)))),
        f"WITH {PREDS}, {WEIGHTS}, {BLEND}, k AS (SELECT fusion, y, list_transform(p, lambda v: round(v, 9)) AS p FROM bl) SELECT fusion, count(*) AS n, count(*) FILTER (list_position(p, list_max(p)) - 1 <> y) AS errors, round(avg(CASE WHEN list_position(p, list_max(p)) - 1 = y THEN 1.0 ELSE 0 END), 6) AS accuracy FROM k GROUP BY fusion",
    ),
    "weight_violations": (
        on(lambda s, p: P.weight_violations(p.groupBy(F.col("split").alias("fusion"), "model").agg((F.avg("conf") - 0.2).alias("w")), ["ref", "cand"]).select("fusion", "negative", rounded("total", 6).alias("total"), "unknown", "repeated")),
        f"WITH {PREDS}, w AS (SELECT split AS fusion, model, avg(conf) - 0.2 AS w FROM preds GROUP BY ALL) SELECT fusion, count(*) FILTER (w < 0) AS negative, round(sum(w), 6) AS total, count(*) FILTER (model NOT IN ('ref', 'cand')) AS unknown, count(*) - count(DISTINCT model) AS repeated FROM w GROUP BY fusion HAVING negative > 0 OR abs(sum(w) - 1) > 1e-9 OR unknown > 0 OR repeated > 0",
    ),
    "seed_mean": (
        on(lambda s, p: P.mean_over(p).select("id", "y", ra())),
        f"WITH {PREDS} SELECT id, y, {RP.format('[avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4]), avg(p[5])]')} AS p FROM preds GROUP BY id, y",
    ),
    "geometric_mean": (
        on(lambda s, p: P.mean_over(p, how="geometric").select("id", "y", ra())),
        f"WITH {PREDS}, g AS (SELECT id, y, [" + ", ".join(f"exp(avg(ln(greatest(p[{k}], 1e-8))))" for k in range(1, 6)) + "] AS q FROM preds GROUP BY id, y) SELECT id, y, list_transform(q, lambda v: round(v / list_sum(q), 9)) AS p FROM g",
    ),
    "worst_condition_accuracy": (
        on(lambda s, p: r(M.accuracy(p, ("model", "yr")).groupBy("model").agg(F.min("accuracy").alias("worst_accuracy"), F.avg("accuracy").alias("mean_accuracy")))),
        f"WITH {PREDS}, a AS (SELECT model, yr, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS a FROM preds GROUP BY ALL) SELECT model, round(min(a), 6) AS worst_accuracy, round(avg(a), 6) AS mean_accuracy FROM a GROUP BY model",
    ),
    "weight_grid": (
        on(lambda s, p: r(P.weight_grid(s, MODELS, 10).join(F.broadcast(p.groupBy("model").agg(F.avg(M.of_label()).alias("own"))), "model").groupBy("weight_id").agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("own")).alias("p_label")))),
        f"WITH {PREDS}, g AS (SELECT a || '|' || b || '|' || (10 - a - b) AS weight_id, [a, b, 10 - a - b] AS n FROM range(11) x(a), range(11) z(b) WHERE a + b <= 10), c AS (SELECT model, avg(p[y + 1]) AS own FROM preds GROUP BY model) SELECT weight_id, round(sum(n[k] / 10), 6) AS total, round(sum(n[k] / 10 * own), 6) AS p_label FROM g, (VALUES ('ref', 1), ('cand', 2), ('third', 3)) t(model, k) JOIN c USING (model) GROUP BY weight_id",
    ),
    "blend_selection": (
        on(lambda s, p: P.select_blend(p, P.weight_grid(s, MODELS, 4), K).select("fusion", "place", rounded("macro_f1", 6).alias("macro_f1"), rounded("log_loss", 6).alias("log_loss"), rounded("ece", 6).alias("ece"))),
        None,
    ),
    "centred_softmax": (
        on(lambda s, p: p.select("model", "id", P.softmax(P.centred_logs("p")).alias("p")).select("model", "id", ra())),
        f"WITH {PREDS}, z AS (SELECT model, id, list_transform(p, lambda v: ln(greatest(v, 1e-12))) AS l FROM preds), c AS (SELECT model, id, list_transform(l, lambda v: v - list_sum(l) / 5) AS z FROM z), e AS (SELECT model, id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM c) SELECT model, id, list_transform(e, lambda v: round(v / list_sum(e), 9)) AS p FROM e",
    ),
    "apply_temperature": (
        on(lambda s, p: p.select("model", "id", P.with_temperature("p", 1.7).alias("p")).select("model", "id", ra())),
        f"WITH {PREDS}, e AS (SELECT model, id, list_transform(p, lambda v: exp(ln(v) / CAST(1.7 AS DOUBLE))) AS e FROM preds) SELECT model, id, list_transform(e, lambda v: round(v / list_sum(e), 9)) AS p FROM e",
    ),
    "fit_temperature": (on(lambda s, p: r(P.fit_temperature(p.where("split = 'val'")))), None),
    "prior_correction": (
        on(lambda s, p: p.select("model", "id", P.with_priors("p", [0.2] * 5, [0.4, 0.3, 0.1, 0.1, 0.1]).alias("p")).select("model", "id", ra())),
        f"WITH {PREDS}, e AS (SELECT model, id, [p[1] * 2, p[2] * 1.5, p[3] * 0.5, p[4] * 0.5, p[5] * 0.5] AS e FROM preds) SELECT model, id, list_transform(e, lambda v: round(v / list_sum(e), 9)) AS p FROM e",
    ),
    "estimate_priors": (on(lambda s, p: r(P.priors_by(p, [0.2] * 5, ("model", "split")).select("model", "split", "rounds", "settled", F.posexplode("priors").alias("cls", "prior")))), None),
    "decision_offsets": (on(lambda s, p: r(P.search_offsets(p, K, by=("model", "split")))), None),
    "factorised_decode": (
        on(lambda s, p: p.select("model", "id", P.factorised(F.col("p")[0], F.col("p")[1]).alias("p")).select("model", "id", ra())),
        f"WITH {PREDS} SELECT model, id, {RP.format('[p[1], (1 - p[1]) * (1 - p[2]), (1 - p[1]) * p[2]]')} AS p FROM preds",
    ),
    "jensen_shannon": (on(lambda s, p: wide(p).select("id", rounded(P.jensen_shannon("pa", "pb"), 6).alias("js"))), f"{WIDE} SELECT id, round({JS}, 6) AS js FROM wide"),
    "stack_features": (
        on(lambda s, p: P.stack_features(wide(p), ["pa", "pb"]).select("id", ra("features"))),
        f"{WIDE} SELECT id, list_transform(list_concat(list_concat({_L.format('pa')}, {_L.format('pb')}), [list_max(pa), {_E.format('pa')}, {_M.format('pa')}, list_max(pb), {_E.format('pb')}, {_M.format('pb')}, {JS}]), lambda v: round(v, 9)) AS features FROM wide",
    ),
    "probability_violations": (
        on(lambda s, p: P.probability_violations(p.withColumn("p", F.when(F.col("id") % 50 == 0, F.transform("p", lambda v: v * 1.01)).otherwise(F.col("p"))).withColumn("y", F.when(F.col("id") % 70 == 1, 9).otherwise(F.col("y"))).where("model = 'ref'"))),
        f"WITH {PREDS} SELECT id, CASE WHEN id % 50 = 0 THEN 'sum' ELSE 'label' END AS reason FROM preds WHERE model = 'ref' AND (id % 50 = 0 OR id % 70 = 1)",
    ),
    "image_probabilities": (
        on(lambda s, p: P.per_image(p.where("model = 'ref'"), "grp").select("grp", "y", ra())),
        f"WITH {PREDS}, g AS (SELECT grp, min(y) AS y, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4]), avg(p[5])] AS q FROM preds WHERE model = 'ref' GROUP BY grp HAVING min(y) = max(y)) SELECT grp, y, list_transform(q, lambda v: round(v / list_sum(q), 9)) AS p FROM g",
    ),
    "prediction_drift": (
        on(lambda s, p: r(P.drift(p.where("model = 'ref'"), p.where("model = 'cand'")))),
        f"""{WIDE}, d AS (SELECT ka, kb, list_sum(list_transform(range(1, 6), lambda k: abs(pa[k] - pb[k]))) / 5 AS g, list_max(list_transform(range(1, 6), lambda k: abs(pa[k] - pb[k]))) AS m, {_M.format('pa')} AS margin FROM wide)
SELECT count(*) AS n, round(avg(CASE WHEN ka = kb THEN 1.0 ELSE 0 END), 6) AS agreement, round(avg(g), 6) AS mean_gap, round(max(m), 6) AS max_gap, round(quantile_cont(margin, 0.5) FILTER (ka <> kb), 6) AS margin_changed, round(quantile_cont(margin, 0.5) FILTER (ka = kb), 6) AS margin_stable FROM d""",
    ),
    "class_priors": (
        on(lambda s, p: r(p.where("model = 'ref'").groupBy("split", "y").agg(F.count("*").alias("n")).withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy("split"))))),
        f"WITH {PREDS} SELECT split, y, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS prior FROM preds WHERE model = 'ref' GROUP BY split, y",
    ),
}
