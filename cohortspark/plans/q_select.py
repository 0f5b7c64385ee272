"""Registered queries: ranking, gates, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import fields as B
from cohortspark.operators import metrics as M
from cohortspark.operators import probs as P
from cohortspark.operators import select as L
from cohortspark.operators import splits as J
from cohortspark.plans.q_metrics import r
from cohortspark.sources import fixtures as X
from cohortspark.sources.fixtures import CLASSES as K


def cand(f):
    return lambda s, d: r(f(X.candidates(s, d)))


def ref(f):
    return lambda s, d: f(X.preds(s, d).where("model = 'ref'").select("id", "grp", "split", "y", "price"))


def _grid(s, d):
    """Log loss of every declared temperature and floor over all predictions of each model."""
    grid = [F.struct(*[F.lit(v).alias(n) for n, v in g.asDict().items()]) for g in L.candidate_grid(s, {"t": [0.5, 1.0, 2.0], "floor": [0.001, 0.05]}).collect()]  # as many as are declared
    rows = X.preds(s, d).select("model", "y", "p", F.explode(F.array(*grid)).alias("g")).select("model", "y", "g.*", P.with_temperature("p", F.col("g.t")).alias("p"))
    floored = F.transform("p", lambda v: F.greatest(v, F.col("floor")))
    return r(M.log_loss(rows.withColumn("p", P.normalised(floored)), ("candidate_id", "t", "floor", "model")))


CAND = f"WITH {X.CANDIDATES}"
REF = f"WITH {X.PREDS}, rr AS (SELECT id, grp, split, y, price FROM preds WHERE model = 'ref')"
DRAW = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)"


def gates(c):
    return L.gated(c, {"macro_f1": F.col("macro_f1") >= 0.3, "log_loss": F.col("log_loss") <= 0.4, "ece": F.col("ece") < 0.15, "epoch": F.col("best_epoch") > 1})


_GATE = "CASE WHEN macro_f1 >= 0.3 THEN NULL ELSE 'macro_f1' END, CASE WHEN log_loss <= 0.4 THEN NULL ELSE 'log_loss' END, CASE WHEN ece < 0.15 THEN NULL ELSE 'ece' END, CASE WHEN best_epoch > 1 THEN NULL ELSE 'epoch' END"


def seed_scores(p):
    """Macro F1 of each model and seed, seeds by the id."""
    rows = p.withColumn("seed", (F.col("id") % 3 * 10 + 42).cast("int"))
    return M.macro_f1(rows, K, ("model", "seed")).withColumnRenamed("macro_f1", "score")


_SEEDS = f"""WITH {X.PREDS}, z AS (SELECT model, id % 3 * 10 + 42 AS seed, k, 2 * count(*) FILTER (y = k AND pred = k) / nullif(count(*) FILTER (y = k) + count(*) FILTER (pred = k), 0) AS f1 FROM preds, range(5) t(k) GROUP BY ALL),
sc AS (SELECT model, seed, avg(coalesce(f1, 0)) AS score FROM z GROUP BY ALL)"""
_Q = """n AS (SELECT y, count(*) AS n FROM rr GROUP BY y), e AS (SELECT y, n, n * CAST({0} AS DOUBLE) / sum(n) OVER () AS e FROM n), b AS (SELECT *, greatest(floor(e), 1) AS q FROM e),
qt AS (SELECT y, n, CAST(q + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, y) <= {0} - sum(q) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b)"""

QUERIES = {
    "holm_stepdown": (lambda s, d: r(L.holm(X.pvalues(s, d), ["family"])),
        f"WITH {X.PVALUES}, a AS (SELECT *, least(p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1), 1) AS s FROM pvalues) SELECT name, family, round(p, 6) AS p, round(max(s) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM a"),
    "lexicographic_ranking": (cand(lambda c: L.ranking(c, ["family"], [F.desc("macro_f1"), F.col("log_loss"), F.col("ece"), F.col("candidate")]).select("candidate", "family", "place", "selected")),
        f"{CAND}, k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY macro_f1 DESC, log_loss, ece, candidate) AS place FROM candidates) SELECT candidate, family, place, place = 1 AS selected FROM k"),
    "tie_band": (cand(lambda c: L.tie_band(c, ["family"], "macro_f1", "log_loss", 0.105, "candidate").select("candidate", "family", "tied", "place")),
        f"{CAND}, t AS (SELECT *, macro_f1 >= max(macro_f1) OVER (PARTITION BY family) - CAST(0.105 AS DOUBLE) AS tied FROM candidates) SELECT candidate, family, tied, row_number() OVER (PARTITION BY family ORDER BY tied DESC, CASE WHEN tied THEN log_loss END, macro_f1 DESC, log_loss, candidate) AS place FROM t"),
    "confirmation_plan": (cand(lambda c: L.confirmation_plan(c, ["family"], "macro_f1", 0.105, "candidate", "seed", [42, 52, 62])),
        f"{CAND}, k AS (SELECT *, max(macro_f1) OVER (PARTITION BY family) AS b FROM candidates) SELECT family, candidate, s.seed FROM k, (VALUES (42), (52), (62)) s(seed) WHERE b - macro_f1 <= CAST(0.105 AS DOUBLE) AND s.seed <> k.seed"),
    "complexity_ranking": (cand(lambda c: L.ranking(c.withColumn("score", F.floor(F.col("macro_f1") * 10)), ["family"], [F.desc("score"), F.struct("complexity", "best_epoch", "candidate").asc()]).select("candidate", "place")),
        f"{CAND} SELECT candidate, row_number() OVER (PARTITION BY family ORDER BY floor(macro_f1 * 10) DESC, complexity, best_epoch, candidate) AS place FROM candidates"),
    "promotion_gate": (cand(lambda c: gates(c).select("candidate", "failed", "passed")), f"{CAND} SELECT candidate, concat_ws(',', {_GATE}) AS failed, failed = '' AS passed FROM candidates"),
    "gate_or_retain": (cand(lambda c: L.select_or_retain(gates(c.withColumn("group", F.col("run") % 12)), ["group"], [F.desc("macro_f1"), F.col("candidate")], "candidate", "incumbent")),
        f"{CAND}, g AS (SELECT *, run % 12 AS \"group\", concat_ws(',', {_GATE}) AS failed FROM candidates) SELECT \"group\", coalesce(max_by(candidate, (macro_f1, -CAST(substr(candidate, 10) AS INT))) FILTER (failed = ''), 'incumbent') AS choice FROM g GROUP BY \"group\""),
    "seed_sensitivity": (lambda s, d: r(L.seed_sensitivity(seed_scores(X.preds(s, d)), [42, 52, 62], ["model"])),
        f"{_SEEDS} SELECT a.model, round(avg(a.score - b.score), 6) AS mean_gain, round(stddev_samp(a.score - b.score), 6) AS sd_gain, bool_and(a.score > b.score) AS all_positive, '' AS problem FROM sc a JOIN sc b ON a.seed = b.seed AND b.model = 'ref' WHERE a.model <> 'ref' GROUP BY a.model"),
    "final_epochs": (cand(lambda c: L.final_epochs(c, ["family"])), f"{CAND} SELECT family, CAST(greatest(round_even(quantile_cont(best_epoch, 0.5), 0), 1) AS INT) AS median_epoch, CAST(greatest(round_even(avg(best_epoch), 0), 1) AS INT) AS mean_epoch FROM candidates GROUP BY family"),
    "carried_values": (cand(lambda c: L.last_known(c.withColumn("rate", F.when(F.col("best_epoch") % 3 == 0, F.col("log_loss"))), ["family"], "candidate", "rate").select("candidate", "carried")),
        f"{CAND} SELECT candidate, round(last_value(CASE WHEN best_epoch % 3 = 0 THEN log_loss END IGNORE NULLS) OVER (PARTITION BY family ORDER BY candidate ROWS UNBOUNDED PRECEDING), 6) AS carried FROM candidates"),
    "candidate_table": (cand(lambda c: L.candidate_table([c.where("family = 0").select("candidate", "macro_f1"), c.where("family = 1").select("candidate", F.col("macro_f1").alias("val_macro_f1"), "ece"), c.where("family = 2").select("candidate", F.col("macro_f1").alias("oof_macro_f1"), "log_loss")], ["macro_f1", "val_macro_f1", "oof_macro_f1"]).select("candidate", "score", "ece", "log_loss")),
        f"{CAND} SELECT candidate, round(macro_f1, 6) AS score, CASE WHEN family = 1 THEN round(ece, 6) END AS ece, CASE WHEN family = 2 THEN round(log_loss, 6) END AS log_loss FROM candidates"),
    "confirmed_components": (cand(lambda c: L.confirmed_components(c, "run", [42, 52, 62], ["complexity"])),
        f"{CAND} SELECT run, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS seeds, count(DISTINCT complexity) AS configs, round(quantile_cont(best_epoch, 0.5), 6) AS median_epoch, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) = '42,52,62' AND count(DISTINCT complexity) = 1 AS consistent FROM candidates GROUP BY run"),
    "assembled_folds": (ref(lambda p: L.assembled_folds([p.where(f"id % 3 = {k}").select("id", "y") for k in range(3)], "id")), f"{REF} SELECT id, y, id % 3 AS fold FROM rr"),
    "candidate_grid": (_grid, f"WITH {X.PREDS}, v(t) AS (VALUES (0.5::DOUBLE), (1.0), (2.0)), w(floor) AS (VALUES (0.001::DOUBLE), (0.05)), e AS (SELECT model, id, y, t, floor, list_transform(p, lambda x: exp(ln(x) / t)) AS e FROM preds, v, w), n AS (SELECT model, y, t, floor, list_transform(e, lambda x: greatest(x / list_sum(e), floor)) AS n FROM e) SELECT 'floor=' || floor || '|t=' || t AS candidate_id, t, floor, model, round(avg(-ln(n[y + 1] / list_sum(n))), 6) AS log_loss FROM n GROUP BY ALL"),
    "view_pairs": (cand(lambda c: L.view_pairs(c.select(F.col("candidate").alias("name"), F.col("run").alias("model"), (F.col("complexity") * 100 + F.col("best_epoch")).alias("view")))),
        f"{CAND}, v AS (SELECT candidate AS name, run AS model, complexity * 100 + best_epoch AS view FROM candidates) SELECT a.name AS \"left\", b.name AS \"right\" FROM v a JOIN v b ON a.name < b.name AND (a.model = b.model OR a.view = b.view)"),
    # splits and samples
    "stratified_folds": (ref(lambda p: J.stratified_folds(p, "y", 5, 42).select("id", "y", "fold")), f"{REF} SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY {DRAW.format(chr(39) + '42|' + chr(39) + ' || id')}, id) - 1) % 5 AS fold FROM rr"),
    "group_folds": (ref(lambda p: J.group_folds(p, "grp", 5).select("id", "grp", "fold")), f"{REF}, g AS (SELECT grp, row_number() OVER (ORDER BY count(*) DESC, grp) - 1 AS a FROM rr GROUP BY grp) SELECT id, grp, CASE WHEN a // 5 % 2 = 0 THEN a % 5 ELSE 4 - a % 5 END AS fold FROM rr JOIN g USING (grp)"),
    "stratified_group_folds": (ref(lambda p: J.stratified_group_folds(p, "grp", "y", 3)), None),
    "fold_table": (ref(lambda p: J.fold_table(p.select("id", "grp"), p.groupBy("grp").agg((F.min("grp") % 4).alias("fold")), "grp")), f"{REF} SELECT grp % 4 AS fold, count(*) AS rows, count(DISTINCT grp) AS groups, sha256(string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY id)) AS digest FROM rr GROUP BY 1"),
    "quotas": (ref(lambda p: J.quotas(p, "y", 1003)), f"{REF}, {_Q.format(1003)} SELECT * FROM qt"),
    "stratified_sample": (ref(lambda p: J.stratified_sample(p, "y", 500, "s1").select("id", "y")), f"{REF}, {_Q.format(500)}, o2 AS (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {DRAW.format(chr(39) + 's1|' + chr(39) + ' || id')}, id) AS a FROM rr) SELECT id, y FROM o2 JOIN qt USING (y) WHERE a <= quota"),
    "nested_subsets": (ref(lambda p: J.nested_subsets(p, "y", [100, 300, 1000], 7)), f"{REF}, s AS (SELECT y, count(*) / sum(count(*)) OVER () AS sh FROM rr GROUP BY y), o2 AS (SELECT id, y, sh, row_number() OVER (PARTITION BY y ORDER BY {DRAW.format(chr(39) + '7|' + chr(39) + ' || id')}, id) AS a FROM rr JOIN s USING (y)) SELECT size, id, y FROM o2, (VALUES (100), (300), (1000)) z(size) WHERE a <= greatest(floor(sh * size + 1e-9), 1)"),
    "fixed_test_protocol": (ref(lambda p: J.fixed_test(p).groupBy("protocol_split").agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups"))), f"{REF} SELECT CASE WHEN split = 'test' THEN 'test' ELSE 'development' END AS protocol_split, count(*) AS n, count(DISTINCT grp) AS groups FROM rr GROUP BY 1"),
    "few_shot": (ref(lambda p: J.few_shot(p, "grp", "y", [1, 5, 20], 3, 11)), None),
    "balanced_strata": (ref(lambda p: J.balanced_strata(B.quartile(p, "price"), ["y", "quartile"], 400, 5).select("id", "y", "quartile")),
        f"{REF}, c AS (SELECT quantile_cont(price, 0.25) AS c1, quantile_cont(price, 0.5) AS c2, quantile_cont(price, 0.75) AS c3 FROM rr), q AS (SELECT id, y, CASE WHEN price <= c1 THEN 1 WHEN price <= c2 THEN 2 WHEN price <= c3 THEN 3 ELSE 4 END AS quartile FROM rr, c) SELECT id, y, quartile FROM q QUALIFY row_number() OVER (PARTITION BY y, quartile ORDER BY {DRAW.format(chr(39) + '5|' + chr(39) + ' || y || ' + chr(39) + '|' + chr(39) + ' || quartile || ' + chr(39) + '|' + chr(39) + ' || id')}, id) <= 20"),
    "balanced_cohort": (ref(lambda p: J.balanced_cohort(p, "y", 40, 20260822).select("id", "y")), f"{REF} SELECT id, y FROM rr QUALIFY row_number() OVER (PARTITION BY y ORDER BY sha256('20260822|' || id), id) <= 40"),
    "stable_seeds": (ref(lambda p: p.select("id", J.stable_seed(F.lit("run"), F.col("grp"), F.col("id")).alias("wide"), J.stable_seed(F.col("id"), wide=False).alias("narrow"))), f"{REF} SELECT id, CAST('0x' || substr(sha256('run|' || grp || '|' || id), 9, 8) AS BIGINT) AS wide, CAST('0x' || substr(sha256(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) AS narrow FROM rr"),
    "class_weights": (ref(lambda p: r(J.class_weights(p, "y"))), f"{REF}, n AS (SELECT y, count(*) AS n FROM rr GROUP BY y), w AS (SELECT y, n, sum(n) OVER () / (count(*) OVER () * n) AS w FROM n) SELECT y, n, round(w / avg(w) OVER (), 6) AS weight FROM w"),
}
