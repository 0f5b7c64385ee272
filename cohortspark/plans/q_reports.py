"""Registered queries: study tables and replayed evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import fields as B
from cohortspark.operators import metrics as M
from cohortspark.operators import probs as P
from cohortspark.operators import reports as R
from cohortspark.plans.q_audit import CLEAN
from cohortspark.plans.q_metrics import AUROC, CLASSES_SQL, r, transitions_sql
from cohortspark.sources import fixtures as X
from cohortspark.sources.fixtures import CLASSES as K
from cohortspark.sources.fixtures import MODELS, PREDS
from cohortspark.sources.tables import table


def q(f):
    return lambda s, d: r(f(X.preds(s, d)))


def cand(f):
    return lambda s, d: r(f(X.candidates(s, d)))


def vec(f):
    return lambda s, d: r(f(X.vectors(s, d)))


def clean(s, d):
    return B.clean_boxes(X.boxes(s, d))


CAND, VEC = f"WITH {X.CANDIDATES}", f"WITH {X.VECTORS}"
WIDE = f"WITH {PREDS}, wd AS (SELECT id, y, list(pred ORDER BY model) AS votes FROM preds GROUP BY id, y)"
STRATA = f"WITH {PREDS}, st AS (SELECT *, 'overall' AS stratum, 'all' AS value FROM preds UNION ALL SELECT *, 'split', split FROM preds UNION ALL SELECT *, 'yr', CAST(yr AS VARCHAR) FROM preds)"
_F1 = "(SELECT {0}, avg(f) AS macro_f1 FROM (SELECT {0}, k, coalesce(2 * count(*) FILTER (y = k AND pred = k) / nullif(count(*) FILTER (y = k) + count(*) FILTER (pred = k), 0), 0) AS f FROM {1}, range(5) t(k) GROUP BY {0}, k) GROUP BY {0})"
_ACC = "avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END)"


def curves(v):
    """Three curves per vector over i / 63: running shares of the components as they stand, sorted down, and sorted up."""
    a = F.transform("features", lambda x: F.abs(x).cast("double"))
    kinds = F.explode(F.array(F.struct(F.lit("deletion").alias("metric"), F.sort_array(a, asc=False).alias("c")), F.struct(F.lit("insertion").alias("metric"), F.sort_array(a).alias("c")), F.struct(F.lit("random").alias("metric"), a.alias("c"))))
    return v.select("vec_id", kinds.alias("k")).select("vec_id", "k.metric", F.posexplode("k.c").alias("i", "y")).select("vec_id", "metric", (F.col("i") / 63).alias("x"), "y")


CURVES = f"""{VEC}, ab AS (SELECT vec_id, list_transform(features, lambda x: abs(x)::DOUBLE) AS a FROM vectors), kn AS (SELECT vec_id, 'deletion' AS metric, list_sort(a, 'DESC') AS c FROM ab UNION ALL SELECT vec_id, 'insertion', list_sort(a) FROM ab UNION ALL SELECT vec_id, 'random', a FROM ab),
cv AS (SELECT vec_id, metric, i / 63 AS x, c[i + 1] AS y FROM kn, range(64) t(i)),
ar AS (SELECT vec_id, metric, sum((y + py) / 2 * (x - px)) / (max(x) - min(x)) AS area FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM cv WINDOW w AS (PARTITION BY vec_id, metric ORDER BY x)) GROUP BY ALL)"""


def _metrics(p):
    return R.long_metrics(M.accuracy(p).join(M.macro(M.per_class(M.confusion(p, K))).hint("merge"), "model"), ["model"])


def _replayed(p):
    now = _metrics(p)
    then = now.withColumn("value", F.when((F.col("model") == "ref") & (F.col("metric") == "accuracy"), F.col("value") + 0.01).otherwise(F.col("value"))).where("NOT (model = 'cand' AND metric = 'errors')").unionByName(
        now.where("model = 'third' AND metric = 'n'").withColumn("metric", F.lit("rows"))
    )
    return R.replay(now, then, ["model", "metric"])


def _ledger(s, d):
    c = X.candidates(s, d)
    declared = c.where("run < 30").select("run", "seed", "complexity", (F.col("best_epoch") + F.when(F.col("run") == 4, 1).otherwise(0)).alias("best_epoch"))
    runs = c.where("run >= 2").select("run", "seed", "complexity", "best_epoch", (F.col("log_loss") * 100).alias("runtime"))
    return r(R.fit_ledger(declared, runs.unionByName(runs.where("run = 7 AND seed = 42")), ["run", "seed"], ["complexity", "best_epoch"]))


_MIX = f"WITH {PREDS}, mx AS (SELECT model, grp, count(DISTINCT pred) AS np FROM preds GROUP BY ALL HAVING count(DISTINCT y) > 1), rw AS (SELECT p.* FROM preds p JOIN mx USING (model, grp))"

QUERIES = {
    "stratum_metrics": (q(lambda p: R.stratum_metrics(p, ["split", "yr"], K)), f"{STRATA} SELECT stratum, value, model, count(*) AS n, count(DISTINCT grp) AS groups, round({_ACC}, 6) AS accuracy, round(any_value(macro_f1), 6) AS macro_f1 FROM st JOIN {_F1.format('stratum, value, model', 'st')} USING (stratum, value, model) GROUP BY stratum, value, model"),
    "stratified_transitions": (q(lambda p: M.transitions(R.with_strata(M.paired(p, "ref", "cand", ["split", "yr"]), ["split", "yr"]), ["stratum", "value"])),
        f"{STRATA}, pr AS (SELECT a.stratum, a.value, a.y, a.pred AS pa, b.pred AS pb FROM st a JOIN st b USING (id, stratum, value) WHERE a.model = 'ref' AND b.model = 'cand') {transitions_sql('stratum, value')}"),
    "ensemble_structure": (q(R.ensemble_structure), f"{WIDE} SELECT count(*) AS n, round(avg(CASE WHEN list_contains(votes, y) THEN 1.0 ELSE 0 END), 6) AS oracle, round(avg(CASE WHEN len(list_distinct(votes)) > 1 THEN 1.0 ELSE 0 END), 6) AS disagreement, count(*) FILTER (len(list_distinct(votes)) = 1 AND NOT list_contains(votes, y)) AS unanimous_errors FROM wd"),
    "ensemble_by_class": (q(lambda p: R.ensemble_structure(p, ["y"])), f"{WIDE} SELECT y, count(*) AS n, round(avg(CASE WHEN list_contains(votes, y) THEN 1.0 ELSE 0 END), 6) AS oracle, round(avg(CASE WHEN len(list_distinct(votes)) > 1 THEN 1.0 ELSE 0 END), 6) AS disagreement, count(*) FILTER (len(list_distinct(votes)) = 1 AND NOT list_contains(votes, y)) AS unanimous_errors FROM wd GROUP BY y"),
    "error_families": (q(lambda p: R.error_families(p, [(0, 1), (2, 3)])), f"WITH {PREDS}, e AS (SELECT model, CASE WHEN least(y, pred) || '-' || greatest(y, pred) IN ('0-1', '2-3') THEN least(y, pred) || '-' || greatest(y, pred) ELSE 'other' END AS family FROM preds WHERE y <> pred) SELECT model, family, count(*) AS errors, round(count(*) / sum(count(*)) OVER (PARTITION BY model), 6) AS share FROM e GROUP BY model, family"),
    "unanimity": (q(lambda p: R.unanimity(p, "cand")), f"{WIDE}, u AS (SELECT 1 AS one, CASE WHEN wd.y <> p.pred THEN 1 ELSE 0 END AS hit, CASE WHEN len(list_distinct(votes)) > 1 THEN 1 ELSE 0 END AS score FROM wd JOIN preds p ON p.id = wd.id AND p.model = 'cand') SELECT count(*) AS n, round(avg(hit) FILTER (score = 0), 6) AS error_unanimous, round(avg(hit) FILTER (score = 1), 6) AS error_differing, (SELECT round(auroc, 6) FROM ({AUROC.format(by='one', rows='u')})) AS auroc FROM u"),
    "adjacent_errors": (q(lambda p: R.adjacent_errors(p, ("model", "yr"))), f"WITH {PREDS} SELECT model, yr, count(*) AS errors, count(*) FILTER (abs(y - pred) = 1) AS adjacent, round(count(*) FILTER (abs(y - pred) = 1) / count(*), 6) AS share FROM preds WHERE y <> pred GROUP BY ALL"),
    "leave_one_out": (q(lambda p: R.leave_one_out(p, [m[0] for m in MODELS], K)),
        f"""WITH {PREDS}, om(omitted) AS (VALUES ('none'), ('ref'), ('cand'), ('third')), bl AS (SELECT omitted, id, y, list_transform([sum(p[1]), sum(p[2]), sum(p[3]), sum(p[4]), sum(p[5])], lambda v: round(v / count(*), 12)) AS p FROM preds JOIN om ON model <> omitted GROUP BY ALL),
rw AS (SELECT omitted, id, y, list_position(p, list_max(p)) - 1 AS pred FROM bl), ag AS (SELECT a.omitted, avg(CASE WHEN a.pred = b.pred THEN 1.0 ELSE 0 END) AS agreement FROM rw a JOIN rw b ON a.id = b.id AND b.omitted = 'none' GROUP BY a.omitted)
SELECT omitted, round({_ACC}, 6) AS accuracy, round(any_value(macro_f1), 6) AS macro_f1, round(any_value(agreement), 6) AS agreement FROM rw JOIN {_F1.format('omitted', 'rw')} USING (omitted) JOIN ag USING (omitted) GROUP BY omitted"""),
    "domain_shift": (lambda s, d: r(R.domain_shift(X.boxes(s, d).where("split = 'train'").withColumn("a", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))), X.boxes(s, d).where("split = 'test'").withColumn("a", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))), "a")),
        f"""WITH {X.BOXES}, v AS (SELECT split, (xmax - xmin) * (ymax - ymin) AS a FROM boxes WHERE split <> 'val'), q AS (SELECT quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.5) AS q2 FROM v WHERE split = 'train'),
c AS (SELECT a, count(*) FILTER (split = 'train') AS n, count(*) FILTER (split = 'test') AS m FROM v GROUP BY a), k AS (SELECT max(abs(cn / tn - cm / tm)) AS ks FROM (SELECT sum(n) OVER (ORDER BY a) AS cn, sum(m) OVER (ORDER BY a) AS cm, sum(n) OVER () AS tn, sum(m) OVER () AS tm FROM c))
SELECT round(q2, 6) AS source_median, round(quantile_cont(a, 0.5), 6) AS target_median, round(quantile_cont(a, 0.5) / q2, 6) AS ratio, round(avg(CASE WHEN a <= q1 THEN 1.0 ELSE 0 END), 6) AS below_q1, round(ks, 6) AS ks FROM v, q, k WHERE split = 'test' GROUP BY q1, q2, ks"""),
    "condition_shares": (q(lambda p: R.shares(p, {"sure": (F.col("conf") > 0.4, F.col("y") == F.col("pred")), "late": (F.col("yr") > 1997, F.col("y") != F.col("pred"))}, ["model"])),
        f"WITH {PREDS}, s AS (SELECT model, 'sure' AS name, count(*) FILTER (conf > 0.4 AND y = pred) AS numerator, count(*) FILTER (y = pred) AS denominator FROM preds GROUP BY model UNION ALL SELECT model, 'late', count(*) FILTER (yr > 1997 AND y <> pred), count(*) FILTER (y <> pred) FROM preds GROUP BY model) SELECT *, round(numerator / nullif(denominator, 0), 6) AS share FROM s"),
    "mixed_images": (q(lambda p: R.mixed_images(p, "grp", K)), f"{_MIX} SELECT model, count(*) AS rows, round({_ACC}, 6) AS accuracy, any_value(i.images) AS images, any_value(i.varying) AS varying, round(any_value(macro_f1), 6) AS macro_f1 FROM rw JOIN (SELECT model, count(*) AS images, count(*) FILTER (np > 1) AS varying FROM mx GROUP BY model) i USING (model) JOIN {_F1.format('model', 'rw')} USING (model) GROUP BY model"),
    "scale_trend": (cand(lambda c: R.scale_trend(c.withColumn("size", F.pow(F.lit(2), F.col("best_epoch"))), "size", "macro_f1")), f"{CAND}, m AS (SELECT best_epoch AS x, avg(macro_f1) AS y FROM candidates GROUP BY 1) SELECT count(*) AS sizes, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM m"),
    "scale_sizes": (cand(lambda c: R.scale_sizes(c, "best_epoch", "macro_f1", digest="family")), f"{CAND} SELECT best_epoch AS size, round(arg_min(macro_f1, {{'a': seed, 'b': macro_f1}}), 6) AS first, count(*) AS n, count(DISTINCT family) AS digests, count(DISTINCT macro_f1) AS scores, digests = 1 AND scores = 1 AS identical FROM candidates GROUP BY best_epoch"),
    "repeated_runs": (cand(lambda c: R.repeated_runs(c, ["family"], "macro_f1")), f"{CAND} SELECT family, count(*) AS runs, count(DISTINCT seed) AS seeds, round(avg(macro_f1), 6) AS mean, round(stddev_samp(macro_f1), 6) AS sd, round(quantile_cont(macro_f1, 0.05), 6) AS q05, round(quantile_cont(macro_f1, 0.5), 6) AS median, round(quantile_cont(macro_f1, 0.95), 6) AS q95 FROM candidates GROUP BY family"),
    "manifest_summary": (lambda s, d: r(R.manifest_summary(table(s, d, "documents").withColumn("sha", F.sha2("text", 256)).withColumn("size", F.length("text")), "size", "sha", ["lang"])), "SELECT lang, count(*) AS n, count(DISTINCT text) AS digests, count(*) - count(DISTINCT text) AS repeated, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.05), 6) AS p05, round(quantile_cont(length(text), 0.5), 6) AS median, round(quantile_cont(length(text), 0.95), 6) AS p95 FROM documents GROUP BY lang"),
    "split_label_pivot": (lambda s, d: X.manifest(s, d).groupBy("split").pivot("label", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).na.fill(0), f"WITH {X.MANIFEST} SELECT split, count(*) FILTER (label = 'de') AS de, count(*) FILTER (label = 'en') AS en, count(*) FILTER (label = 'es') AS es, count(*) FILTER (label = 'fr') AS fr FROM manifest GROUP BY split"),
    "action_combinations": (lambda s, d: X.actions(s, d).groupBy("image", F.array_join("actions", "|").alias("combination")).agg(F.count("*").alias("n")), f"WITH {X.ACTIONS} SELECT image, array_to_string(actions, '|') AS combination, count(*) AS n FROM actions GROUP BY ALL"),
    "worst_errors": (lambda s, d: r(R.top_rows(X.preds(s, d).where("y <> pred"), ["model", "y"], [F.desc("conf"), F.col("id")], 5).join(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus").hint("merge"), "id").select("model", "y", "pred", "id", "conf", "o_orderstatus")),
        f"WITH {PREDS}, k AS (SELECT * FROM preds WHERE y <> pred QUALIFY row_number() OVER (PARTITION BY model, y ORDER BY conf DESC, id) <= 5) SELECT model, y, pred, id, round(conf, 6) AS conf, o_orderstatus FROM k JOIN orders ON o_orderkey = id"),
    "majority_class": (q(lambda p: p.where("model = 'ref'").groupBy("split", "y").agg(F.count("*").alias("n")).groupBy("split").agg(F.max(F.struct("n", (-F.col("y")).alias("m"))).alias("b"), F.sum("n").alias("t")).select("split", (-F.col("b.m")).alias("y"), (F.col("b.n") / F.col("t")).alias("share"))),
        f"WITH {PREDS}, n AS (SELECT split, y, count(*) AS n FROM preds WHERE model = 'ref' GROUP BY ALL) SELECT split, max_by(y, (n, -y)) AS y, round(max(n) / sum(n), 6) AS share FROM n GROUP BY split"),
    "map_agreement": (vec(lambda v: R.map_agreement(v.select("vec_id", F.slice("features", 1, 32).alias("a"), F.transform(F.slice("features", 33, 32), lambda x: F.round(x, 1)).alias("b")), "a", "b", "vec_id")),
        f"{VEC}, z AS (SELECT vec_id, unnest(features[1:32]) AS a, unnest(list_transform(features[33:64], lambda x: round(x, 1))) AS b FROM vectors), k AS (SELECT vec_id, rank() OVER (PARTITION BY vec_id ORDER BY a) + (count(*) OVER (PARTITION BY vec_id, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY vec_id ORDER BY b) + (count(*) OVER (PARTITION BY vec_id, b) - 1) / 2 AS rb FROM z) SELECT vec_id, round(corr(ra, rb), 6) AS spearman FROM k GROUP BY vec_id"),
    "curve_areas": (vec(lambda v: M.curve_area(curves(v), ("vec_id", "metric"))), f"{CURVES} SELECT vec_id, metric, round(area, 6) AS area FROM ar"),
    "faithfulness": (vec(lambda v: R.faithfulness(curves(v), "vec_id")), f"{CURVES} SELECT vec_id, round(max(area) FILTER (metric = 'deletion'), 6) AS deletion, round(max(area) FILTER (metric = 'insertion'), 6) AS insertion, round(max(area) FILTER (metric = 'random'), 6) AS random, round(max(area) FILTER (metric = 'random') - max(area) FILTER (metric = 'deletion'), 6) AS gap FROM ar GROUP BY vec_id"),
    "road": (vec(lambda v: R.road(curves(v).withColumns({"metric": F.expr("CASE metric WHEN 'deletion' THEN 'most' WHEN 'insertion' THEN 'least' ELSE metric END"), "y": F.when(F.col("metric") == "insertion", F.col("y") * F.col("y")).otherwise(F.col("y"))}), "vec_id")),
        f"""{CURVES}, c2 AS (SELECT vec_id, CASE metric WHEN 'deletion' THEN 'most' WHEN 'insertion' THEN 'least' ELSE metric END AS metric, x, CASE WHEN metric = 'insertion' THEN y * y ELSE y END AS y FROM cv),
a2 AS (SELECT vec_id, metric, sum((y + py) / 2 * (x - px)) / (max(x) - min(x)) AS area FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM c2 WINDOW w AS (PARTITION BY vec_id, metric ORDER BY x)) GROUP BY ALL),
cb AS (SELECT a.vec_id, avg((b.y - a.y) / 2) AS combined FROM c2 a JOIN c2 b ON a.vec_id = b.vec_id AND a.x = b.x AND a.metric = 'most' AND b.metric = 'least' GROUP BY 1)
SELECT vec_id, round(max(area) FILTER (metric = 'most'), 6) AS most, round(max(area) FILTER (metric = 'least'), 6) AS least, round(max(area) FILTER (metric = 'random'), 6) AS random, round(max(area) FILTER (metric = 'least') - max(area) FILTER (metric = 'most'), 6) AS gap, round(max(combined), 6) AS combined FROM a2 JOIN cb USING (vec_id) GROUP BY vec_id"""),
    "subset_faithfulness": (vec(lambda v: R.subset_faithfulness(v.select("vec_id", F.lit(1.0).alias("original"), F.posexplode(F.slice("features", 1, 32)).alias("i", "m"), "features").select("vec_id", "original", (F.floor(F.abs(F.col("m").cast("double")) * 10) / 10).alias("mass"), F.expr("floor(abs(CAST(features[i + 32] AS DOUBLE)) * 10) / 10").cast("double").alias("probability")), "vec_id")),
        f"{VEC}, z AS (SELECT vec_id, floor(abs(CAST(features[i + 1] AS DOUBLE)) * 10) / 10 AS a, 1.0::DOUBLE - floor(abs(CAST(features[i + 33] AS DOUBLE)) * 10) / 10 AS b FROM vectors, range(32) t(i)), k AS (SELECT vec_id, rank() OVER (PARTITION BY vec_id ORDER BY a) + (count(*) OVER (PARTITION BY vec_id, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY vec_id ORDER BY b) + (count(*) OVER (PARTITION BY vec_id, b) - 1) / 2 AS rb FROM z) SELECT vec_id, count(*) AS subsets, round(corr(ra, rb), 6) AS spearman FROM k GROUP BY vec_id"),
    "localisation": (vec(lambda v: R.localisation(v.select("vec_id", F.transform("features", lambda x: F.abs(x).cast("double")).alias("m"), (F.col("vec_id") % 4).alias("x0"), F.lit(2).alias("y0"), (F.col("vec_id") % 4 + 4).alias("x1"), F.lit(6).alias("y1")), "m", 8, ("x0", "y0", "x1", "y1"), "vec_id")),
        f"""{VEC}, c AS (SELECT vec_id, i, abs(features[i + 1])::DOUBLE AS v, i % 8 >= vec_id % 4 AND i % 8 < vec_id % 4 + 4 AND i // 8 >= 2 AND i // 8 < 6 AS inside FROM vectors, range(64) t(i)),
g AS (SELECT vec_id, sum(CASE WHEN inside THEN v ELSE 0 END) / sum(v) AS mass, avg(CASE WHEN inside THEN 1.0 ELSE 0 END) AS area, max_by(inside, (v, -i)) AS pointing FROM c GROUP BY vec_id) SELECT vec_id, round(mass, 6) AS mass, round(area, 6) AS area, round(mass / area, 6) AS lift, pointing FROM g"""),
    "method_selection": (cand(lambda c: R.method_table(c.withColumn("eligible", F.col("complexity") < 4), ["family", "complexity"], "eligible", "macro_f1")),
        f"{CAND}, m AS (SELECT family, complexity, complexity < 4 AS eligible, count(*) AS n, avg(macro_f1) AS mean, stddev_samp(macro_f1) AS sd FROM candidates GROUP BY ALL) SELECT family, complexity, eligible, n, round(mean, 6) AS mean, round(sd, 6) AS sd, CASE WHEN eligible THEN row_number() OVER (PARTITION BY family, eligible ORDER BY round(mean, 9) DESC, round(sd, 9), family, complexity) END AS place FROM m"),
    "geometry_medians": (lambda s, d: r(R.medians(B.geometry(clean(s, d)), ["label"], ["area_fraction", "aspect", "pixel_height"])),
        f"{CLEAN} SELECT label, count(*) AS n, round(quantile_cont(area_fraction, 0.5), 6) AS median_area_fraction, round(quantile_cont(greatest(x1 - x0, 1) / greatest(y1 - y0, 1), 0.5), 6) AS median_aspect, round(quantile_cont(greatest(y1 - y0, 1), 0.5), 6) AS median_pixel_height FROM cb GROUP BY label"),
    "attribution_strata": (vec(lambda v: M.curve_area(curves(v), ("vec_id", "metric")).join(v.select("vec_id", "label").hint("merge"), "vec_id").groupBy("label", "metric").agg(F.avg("area").alias("mean_area"), F.count("*").alias("n"))), f"{CURVES} SELECT label, metric, round(avg(area), 6) AS mean_area, count(*) AS n FROM ar JOIN vectors USING (vec_id) GROUP BY label, metric"),
    # replay
    "metric_replay": (q(_replayed),
        f"""{CLASSES_SQL}, mm AS (SELECT model, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS acc, count(*) AS n, count(*) FILTER (y <> pred) AS errors FROM preds GROUP BY model)
SELECT model, 'accuracy' AS metric, round(acc, 6) AS actual, round(acc + 0.01, 6) AS expected, 'changed' AS problem FROM mm WHERE model = 'ref' UNION ALL SELECT model, 'errors', errors, NULL, 'extra' FROM mm WHERE model = 'cand' UNION ALL SELECT model, 'rows', NULL, n, 'missing' FROM mm WHERE model = 'third'"""),
    "blend_replay": (lambda s, d: r(R.probability_gap(P.mean_over(X.preds(s, d)), P.blend(X.preds(s, d), s.createDataFrame([("e", m[0], 1 / 3) for m in MODELS], "fusion string, model string, w double")), ["id"], 1e-9)),
        "SELECT count(*) AS rows, 0.0 AS max_gap, 0.0 AS mean_gap, 1.0 AS same_class, true AS within FROM orders"),
    "prediction_replay": (q(lambda p: R.probability_gap(p.where("model = 'ref'"), p.where("model = 'cand'"), ["id"], 0.5)),
        f"WITH {PREDS}, g AS (SELECT list_max(list_transform(range(1, 6), lambda k: abs(a.p[k] - b.p[k]))) AS m, list_sum(list_transform(range(1, 6), lambda k: abs(a.p[k] - b.p[k]))) / 5 AS g, CASE WHEN a.pred = b.pred THEN 1.0 ELSE 0 END AS s FROM preds a JOIN preds b ON a.id = b.id AND a.model = 'ref' AND b.model = 'cand') SELECT count(*) AS rows, round(max(m), 6) AS max_gap, round(avg(g), 6) AS mean_gap, round(avg(s), 6) AS same_class, max(m) <= 0.5 AS within FROM g"),
    "digest_bindings": (lambda s, d: R.bindings(X.manifest(s, d).select(F.col("id").alias("path"), "sha256").where("path % 50 <> 1"), X.manifest(s, d).select(F.col("id").alias("path"), F.when(F.col("id") % 70 == 2, F.lit("0")).otherwise(F.col("sha256")).alias("sha256")).where("path % 60 <> 3")),
        "SELECT path, problem FROM (SELECT doc_id AS path, CASE WHEN doc_id % 60 = 3 AND doc_id % 50 <> 1 THEN 'missing' WHEN doc_id % 50 = 1 AND doc_id % 60 <> 3 THEN 'extra' WHEN doc_id % 50 <> 1 AND doc_id % 60 <> 3 AND doc_id % 70 = 2 THEN 'changed' END AS problem FROM documents) WHERE problem IS NOT NULL"),
    "matrix_rescoring": (q(lambda p: R.rescored(M.confusion(p, K, ("model", "split")), ["model", "split"])),
        f"WITH {PREDS}, pc AS (SELECT model, split, k, count(*) FILTER (y = k) AS s, coalesce(2 * count(*) FILTER (y = k AND pred = k) / nullif(count(*) FILTER (y = k) + count(*) FILTER (pred = k), 0), 0) AS f, count(*) AS n, count(*) FILTER (y = pred) AS t FROM preds, range(5) t(k) GROUP BY ALL) SELECT model, split, max(n) AS n, round(max(t) / max(n), 6) AS accuracy, round(avg(f), 6) AS macro_f1, round(sum(f * s) / sum(s), 6) AS weighted_f1 FROM pc GROUP BY model, split"),
    "fit_ledger": (_ledger,
        f"""{CAND}, dc AS (SELECT run, seed, complexity, best_epoch + CASE WHEN run = 4 THEN 1 ELSE 0 END AS best_epoch FROM candidates WHERE run < 30), ru AS (SELECT run, seed, complexity, best_epoch, log_loss * 100 AS runtime FROM candidates WHERE run >= 2 UNION ALL SELECT run, seed, complexity, best_epoch, log_loss * 100 FROM candidates WHERE run = 7 AND seed = 42),
h AS (SELECT run, seed, count(*) AS runs, sum(runtime) AS runtime, max(complexity) AS c, max(best_epoch) AS e FROM ru GROUP BY ALL) SELECT run, seed, coalesce(runs, 0) AS runs, round(runtime, 6) AS runtime, CASE WHEN runs IS NULL THEN 'missing' WHEN complexity IS NULL THEN 'undeclared' WHEN runs > 1 THEN 'repeated' WHEN best_epoch <> e THEN 'best_epoch' ELSE '' END AS problem FROM dc FULL JOIN h USING (run, seed)"""),
}
