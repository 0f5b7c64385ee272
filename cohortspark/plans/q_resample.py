"""Registered queries: bootstrap and randomization."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import draws as D
from cohortspark.operators import gates as G
from cohortspark.operators import metrics as M
from cohortspark.operators import resample as H
from cohortspark.operators.select import gated
from cohortspark.plans.q_metrics import r
from cohortspark.sources.fixtures import CLASSES as K
from cohortspark.sources.fixtures import PREDS, preds

BOOT, RAND, SEED = 100, 100, 2026


def pair(f):
    return lambda s, d: r(f(M.paired(preds(s, d), "ref", "cand")))


def _w(u: str) -> str:
    return " + ".join(f"CASE WHEN {u} >= {t} THEN 1 ELSE 0 END" for t in H.POISSON)


def _u(seed: object, key: str = "grp") -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || draw || '|' || {key}), 1, 8) AS BIGINT)"


PAIR = f"WITH {PREDS}, pr AS (SELECT 'c' AS comparison, a.id, a.grp, a.y, a.pred AS pa, b.pred AS pb FROM preds a JOIN preds b ON a.id = b.id AND a.model = 'ref' AND b.model = 'cand')"
PAIRS = f"WITH {PREDS}, cm(comparison, reference, candidate) AS (VALUES ('cand-ref', 'ref', 'cand'), ('third-ref', 'ref', 'third'), ('cand-third', 'third', 'cand')), pr AS (SELECT comparison, a.id, a.grp, a.y, a.pred AS pa, b.pred AS pb FROM cm JOIN preds a ON a.model = cm.reference JOIN preds b ON b.model = cm.candidate AND a.id = b.id)"
CELLS = "ce AS (SELECT comparison, grp, y, pa, pb, count(*) AS n FROM pr GROUP BY ALL)"
_MIX = f"list_reduce([CAST({{0}} AS BIGINT), 1, 2, 3], lambda v, i: (xor(v, v >> CASE i {' '.join(f'WHEN {k} THEN {a}' for k, (a, _) in enumerate(D.MIX, 1))} END) * CASE i {' '.join(f'WHEN {k} THEN {b}' for k, (_, b) in enumerate(D.MIX, 1))} END) & 4294967295)"


def _numbers(name: str, seed: object, draws: int) -> str:
    """(grp, draw, u): the numbers of ``draws.mixed_numbers``."""
    half = lambda k: f"CAST('0x' || substr(md5(CAST(grp AS VARCHAR)), {k}, 8) AS BIGINT)"
    start = _MIX.format(f"CAST('0x' || substr(md5('{seed}'), 1, 8) AS BIGINT)")
    return f"""{name}d AS (SELECT draw, {_MIX.format(f"xor({start}, draw)")} AS o FROM range({draws}) t(draw)), {name}g AS (SELECT grp, {half(1)} AS hi, {half(9)} AS lo FROM (SELECT DISTINCT grp FROM pr)),
{name} AS (SELECT grp, draw, {_MIX.format(f"xor({_MIX.format('xor(o, hi)')}, lo)")} AS u FROM {name}g, {name}d)"""


BOOTED = f"{CELLS}, dr AS (SELECT comparison, draw, y, pa, pb, sum(n * ({_w(_u(SEED))})) AS n FROM ce, range({BOOT}) t(draw) GROUP BY ALL UNION ALL SELECT comparison, -1, y, pa, pb, sum(n) FROM ce GROUP BY ALL)"


def _swapped(seed: object) -> str:
    return f"""{CELLS}, dr AS (SELECT comparison, draw, y, pa, pb, sum(n) AS n FROM (SELECT comparison, draw, y, CASE WHEN c = 1 THEN pb ELSE pa END AS pa, CASE WHEN c = 1 THEN pa ELSE pb END AS pb, n FROM
  (SELECT *, {_u(seed)} % 2 AS c FROM ce, range({RAND}) t(draw))) GROUP BY ALL UNION ALL SELECT comparison, -1, y, pa, pb, sum(n) FROM ce GROUP BY ALL)"""


DELTAS = """cf AS (SELECT comparison, draw, k AS cls, coalesce(2 * sum(CASE WHEN y = k AND pa = k THEN n END) / nullif(sum(CASE WHEN y = k THEN n ELSE 0 END) + sum(CASE WHEN pa = k THEN n ELSE 0 END), 0), 0) AS fa,
  coalesce(2 * sum(CASE WHEN y = k AND pb = k THEN n END) / nullif(sum(CASE WHEN y = k THEN n ELSE 0 END) + sum(CASE WHEN pb = k THEN n ELSE 0 END), 0), 0) AS fb, sum(CASE WHEN y = k THEN n ELSE 0 END) AS support FROM dr, range(5) t(k) GROUP BY ALL),
de AS (SELECT comparison, draw, sum(fa) / 5 AS macro_a, sum(fb) / 5 AS macro_b, sum(fb) / 5 - sum(fa) / 5 AS delta, count(*) FILTER (support > 0) AS classes FROM cf GROUP BY ALL)"""


def _interval(rows: str, by: str, value: str = "delta") -> str:
    return f"""SELECT {by}max({value}) FILTER (draw < 0) AS point, quantile_cont({value}, 0.025) FILTER (draw >= 0) AS low, quantile_cont({value}, 0.975) FILTER (draw >= 0) AS high,
  avg(CASE WHEN {value} > 0 THEN 1.0 ELSE 0 END) FILTER (draw >= 0) AS p_positive, least(1, 2 * least(count(*) FILTER (draw >= 0 AND {value} <= 0) + 1, count(*) FILTER (draw >= 0 AND {value} >= 0) + 1) / (count(*) FILTER (draw >= 0) + 1)) AS p_two_sided,
  count(*) FILTER (draw >= 0) AS draws FROM {rows} {'GROUP BY ' + by.rstrip(', ') if by else ''}"""


_OUT = "round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high, round(p_positive, 6) AS p_positive, round(p_two_sided, 6) AS p_two_sided, draws"
_TEST = "SELECT comparison, o AS observed, count(*) FILTER (abs(delta) >= abs(o) - 1e-12) AS extreme, (count(*) FILTER (abs(delta) >= abs(o) - 1e-12) + 1) / (count(*) + 1) AS p FROM de JOIN (SELECT comparison, delta AS o FROM de WHERE draw = -1) USING (comparison) WHERE draw >= 0 GROUP BY ALL"


def _compared(s, d):
    """All comparisons with the reference; the split stands for the run that both models share."""
    p = preds(s, d)
    side = lambda m, x: p.where(F.col("model") == m).select("id", F.col("pred").alias(f"pred_{x}"), F.col("p").alias(f"p_{x}"))
    base = p.where("model = 'ref'").select("id", "grp", "y", F.col("split").alias("run"), F.col("pred").alias("pred_a"), F.col("p").alias("p_a"))
    each = [base.join(side(m, "b").hint("merge"), "id").withColumn("comparison", F.lit(f"{m}-ref")) for m in ("cand", "third")]
    return each[0].unionByName(each[1])


_DECLARED = [("cand-ref", "ref", "cand"), ("third-ref", "ref", "third"), ("cand-third", "third", "cand")]


def _declared(s):
    return s.createDataFrame(_DECLARED, "comparison string, reference string, candidate string")


COMPARED = f"""WITH {PREDS}, cm(comparison, candidate) AS (VALUES ('cand-ref', 'cand'), ('third-ref', 'third')), pr AS (SELECT comparison, a.id, a.grp, a.y, a.split AS run, a.pred AS pa, b.pred AS pb, a.p AS p_a, b.p AS p_b FROM cm JOIN preds a ON a.model = 'ref' JOIN preds b ON b.model = cm.candidate AND a.id = b.id)"""
_F1 = "coalesce(2 * count(*) FILTER (y = k AND {0} = k) / nullif(count(*) FILTER (y = k) + count(*) FILTER ({0} = k), 0), 0)"
_BR = "list_sum(list_transform([1, 2, 3, 4, 5], lambda j: power({0}[j] - CASE WHEN j = y + 1 THEN 1 ELSE 0 END, 2)))"
FIGURES = f"""fc AS (SELECT comparison, k, {_F1.format('pb')} - {_F1.format('pa')} AS gain FROM pr, range(5) t(k) GROUP BY ALL),
fr AS (SELECT comparison, run, k, {_F1.format('pb')} - {_F1.format('pa')} AS gain FROM pr, range(5) t(k) GROUP BY ALL), fg AS (SELECT comparison, run, sum(gain) / 5 AS gain FROM fr GROUP BY ALL),
fn AS (SELECT comparison, run, count(*) FILTER (pa <> y AND pb = y) - count(*) FILTER (pa = y AND pb <> y) AS net FROM pr GROUP BY ALL),
fx AS (SELECT comparison, avg(ln(greatest(p_a[y + 1], 2.220446049250313e-16)) - ln(greatest(p_b[y + 1], 2.220446049250313e-16))) AS nll_increase, avg({_BR.format('p_b')} - {_BR.format('p_a')}) AS brier_increase, count(*) FILTER (pa <> y AND pb = y) AS rescued, count(*) FILTER (pa = y AND pb <> y) AS harmed FROM pr GROUP BY comparison),
fi AS (SELECT fx.*, rescued - harmed AS net, (SELECT sum(gain) / 5 FROM fc WHERE fc.comparison = fx.comparison) AS macro_gain, (SELECT min(gain) FROM fc WHERE fc.comparison = fx.comparison) AS class_gain,
  (SELECT min(gain) FROM fg WHERE fg.comparison = fx.comparison) AS least_run_gain, (SELECT min(net) FROM fn WHERE fn.comparison = fx.comparison) AS least_run_net, (SELECT count(*) FROM fn WHERE fn.comparison = fx.comparison) AS runs FROM fx)"""
_FIGS = "round(macro_gain, 6) AS macro_gain, round(class_gain, 6) AS class_gain, round(nll_increase, 6) AS nll_increase, round(brier_increase, 6) AS brier_increase, rescued, harmed, net, runs, round(least_run_gain, 6) AS least_run_gain, least_run_net"
_FIG_NAMES = ["comparison", "macro_gain", "class_gain", "nll_increase", "brier_increase", "rescued", "harmed", "net", "runs", "least_run_gain", "least_run_net"]


def _failed(checks: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN NULL ELSE '{n}' END" for n, c in checks.items()) + ")"


_SAFE = {"class_drop": "class_gain >= CAST(-0.02 AS DOUBLE)", "nll": "nll_increase <= 0.02", "brier": "brier_increase <= 0.01"}
_LOCKED = {"gain": "macro_gain > 0", "net": "net > 0", "interval": "low > 0", "holm": "p_holm < 0.05", **_SAFE, "runs_gain": "least_run_gain > 0", "runs_net": "least_run_net > 0"}
_DEVELOPMENT = {"gain": "macro_gain >= 0.01", "net": "net >= 1", "runs_gain": "runs = 3 AND least_run_gain > 0", "runs_net": "runs = 3 AND least_run_net > 0", **_SAFE}


def _holm(rows: str, p: str, out: str) -> str:
    return f"(SELECT *, max(s) OVER (ORDER BY {p}, comparison ROWS UNBOUNDED PRECEDING) AS {out} FROM (SELECT *, least({p} * (count(*) OVER () - row_number() OVER (ORDER BY {p}, comparison) + 1), 1) AS s FROM {rows}))"


def _rare(s, d):
    """Pairs whose last class is that of the dearest order alone, so that some draws lack it."""
    p = M.paired(preds(s, d), "ref", "cand", ["price"])
    top = F.broadcast(p.agg(F.max("price").alias("top")))
    return p.join(top).withColumn("y", F.when(F.col("price") == F.col("top"), 4).when(F.col("y") == 4, 3).otherwise(F.col("y")))


QUERIES = {
    "cluster_bootstrap": (pair(lambda p: H.interval(H.deltas(H.cluster_draws(p, BOOT, SEED), K))), f"{PAIR}, {BOOTED}, {DELTAS} SELECT {_OUT} FROM ({_interval('de', '')})"),
    "bootstrap_draws": (pair(lambda p: H.deltas(H.cluster_draws(p, BOOT, SEED), K).select("draw", "macro_a", "macro_b", "delta", "classes")), f"{PAIR}, {BOOTED}, {DELTAS} SELECT draw, round(macro_a, 6) AS macro_a, round(macro_b, 6) AS macro_b, round(delta, 6) AS delta, classes FROM de"),
    "class_bootstrap": (pair(lambda p: H.interval(H.class_deltas(H.cluster_draws(p, BOOT, SEED), K), by=("cls",))), f"{PAIR}, {BOOTED}, {DELTAS}, cd AS (SELECT draw, cls, fb - fa AS delta FROM cf) SELECT cls, {_OUT} FROM ({_interval('cd', 'cls, ')})"),
    "complete_draws": (lambda s, d: r(H.interval(H.complete_draws(H.deltas(H.cluster_draws(_rare(s, d), BOOT, SEED), K), K, 40), by=("rejected",)).select("rejected", "point", "low", "high", "draws")),
        f"{PAIR.replace('a.y, a.pred AS pa', 'CASE WHEN a.price = (SELECT max(o_totalprice) FROM orders) THEN 4 WHEN a.y = 4 THEN 3 ELSE a.y END AS y, a.pred AS pa')}, {BOOTED}, {DELTAS}, ok AS (SELECT * FROM de WHERE draw < 0 UNION ALL (SELECT * FROM de WHERE draw >= 0 AND classes = 5 ORDER BY draw LIMIT 40)) SELECT (SELECT count(*) FROM de WHERE draw >= 0 AND classes < 5) AS rejected, round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high, draws FROM ({_interval('ok', '')})"),
    "stratified_bootstrap": (pair(lambda p: H.interval(H.stratified_bootstrap(p, K, 400, 7))), None),
    "randomization_test": (pair(lambda p: H.randomization(p, K, RAND, "r1")), f"{PAIR}, {_swapped('r1')}, {DELTAS} SELECT round(observed, 6) AS observed, extreme, round(p, 6) AS p FROM ({_TEST})"),
    "mean_bootstrap": (lambda s, d: r(H.interval(H.mean_draws(preds(s, d).where("model = 'ref'").withColumn("v", F.when(F.col("id") % 9 != 0, F.col("conf"))), "v", 50, "m1", by=("y",)).withColumn("draws_excluded", F.col("excluded")), "mean", ("y", "excluded")).select("y", "excluded", "point", "low", "high", "draws")),
        f"""WITH {PREDS}, rw AS (SELECT y, id, conf FROM preds WHERE model = 'ref' AND id % 9 <> 0), ex AS (SELECT y, count(*) FILTER (id % 9 = 0) AS excluded FROM preds WHERE model = 'ref' GROUP BY y),
dm AS (SELECT y, draw, sum(w * conf) / sum(w) AS mean FROM (SELECT *, {_w(_u('m1', 'id'))} AS w FROM rw, range(50) t(draw)) GROUP BY ALL UNION ALL SELECT y, -1, avg(conf) FROM rw GROUP BY y) SELECT y, excluded, round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high, draws FROM ({_interval('dm', 'y, ', 'mean')}) JOIN ex USING (y)"""),
    "auroc_bootstrap": (lambda s, d: r(H.interval(H.auroc_draws(preds(s, d).where("model = 'ref'").select("grp", F.round("conf", 3).alias("score"), (F.col("y") == F.col("pred")).cast("int").alias("hit")), 30, "a1"), "auroc").select("point", "low", "high", "draws")),
        f"""WITH {PREDS}, rw AS (SELECT grp, round(conf, 3) AS score, sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y <> pred THEN 1 ELSE 0 END) AS neg FROM preds WHERE model = 'ref' GROUP BY ALL),
dr AS (SELECT draw, score, sum(w * pos) AS pos, sum(w * neg) AS neg FROM (SELECT *, {_w(_u('a1'))} AS w FROM rw, range(30) t(draw)) GROUP BY ALL UNION ALL SELECT -1, score, sum(pos), sum(neg) FROM rw GROUP BY score),
au AS (SELECT draw, sum(pos * (coalesce(nb, 0) + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM (SELECT *, sum(neg) OVER (PARTITION BY draw ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM dr) GROUP BY draw)
SELECT round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high, draws FROM ({_interval('au', '', 'auroc')})"""),
    "auroc_draws": (lambda s, d: r(H.auroc_draws(preds(s, d).where("model = 'cand'").select("grp", F.col("conf").alias("score"), (F.col("y") == F.col("pred")).cast("int").alias("hit")), 40, "a2")),
        f"""WITH {PREDS}, rw AS (SELECT grp, conf AS score, sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y <> pred THEN 1 ELSE 0 END) AS neg FROM preds WHERE model = 'cand' GROUP BY ALL),
dr AS (SELECT draw, score, sum(w * pos) AS pos, sum(w * neg) AS neg FROM (SELECT *, {_w(_u('a2'))} AS w FROM rw, range(40) t(draw)) GROUP BY ALL UNION ALL SELECT -1, score, sum(pos), sum(neg) FROM rw GROUP BY score)
SELECT draw, round(sum(pos * (coalesce(nb, 0) + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auroc FROM (SELECT *, sum(neg) OVER (PARTITION BY draw ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM dr) GROUP BY draw"""),
    "comparison_run": (lambda s, d: r(H.comparison_run(preds(s, d), s.createDataFrame([("cand-ref", "ref", "cand"), ("third-ref", "ref", "third"), ("cand-third", "third", "cand")], "comparison string, reference string, candidate string"), K, BOOT, RAND, SEED)),
        f"""{PAIRS}, {BOOTED}, {DELTAS}, iv AS ({_interval('de', 'comparison, ')}), te AS (WITH {_swapped(f'{SEED}r')}, {DELTAS} {_TEST}), j AS (SELECT iv.*, te.p FROM iv JOIN te USING (comparison)),
h AS (SELECT *, least(p * (count(*) OVER () - row_number() OVER (ORDER BY p, comparison) + 1), 1) AS s FROM j), g AS (SELECT *, max(s) OVER (ORDER BY p, comparison ROWS UNBOUNDED PRECEDING) AS p_holm FROM h)
SELECT comparison, round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, round(p_holm, 6) AS p_holm, low > 0 AND p_holm <= 0.05 AS superior FROM g"""),
    "joint_comparison_run": (lambda s, d: r(D.comparisons_of(preds(s, d), _declared(s), K, BOOT, RAND, SEED)),
        f"""{PAIRS}, {CELLS}, {_numbers('us', SEED, BOOT)}, {_numbers('un', f'{SEED}r', RAND)}, dr AS (SELECT comparison, draw, y, pa, pb, sum(n * ({_w('u')})) AS n FROM ce JOIN us USING (grp) GROUP BY ALL UNION ALL SELECT comparison, -1, y, pa, pb, sum(n) FROM ce GROUP BY ALL), {DELTAS},
iv AS ({_interval('de', 'comparison, ')}), te AS (WITH dr AS (SELECT comparison, draw, y, CASE WHEN u & 1 = 1 THEN pb ELSE pa END AS pa, CASE WHEN u & 1 = 1 THEN pa ELSE pb END AS pb, sum(n) AS n FROM ce JOIN un USING (grp) GROUP BY ALL UNION ALL SELECT comparison, -1, y, pa, pb, sum(n) FROM ce GROUP BY ALL), {DELTAS} {_TEST}), j AS (SELECT iv.*, te.p FROM iv JOIN te USING (comparison))
SELECT comparison, round(point, 6) AS point, round(low, 6) AS low, round(high, 6) AS high, round(p, 6) AS p, round(p_holm, 6) AS p_holm, low > 0 AND p_holm <= 0.05 AS superior FROM {_holm('j', 'p', 'p_holm')}"""),
    "model_draws": (lambda s, d: r(D.model_draws(preds(s, d), K, BOOT, SEED).select("model", "draw", "macro", "accuracy", "classes")),
        f"""WITH {PREDS}, pr AS (SELECT grp FROM preds), ce AS (SELECT model, grp, y, pred, count(*) AS n FROM preds GROUP BY ALL), {_numbers('us', SEED, BOOT)}, dr AS (SELECT model, draw, y, pred, sum(n * ({_w('u')})) AS n FROM ce JOIN us USING (grp) GROUP BY ALL UNION ALL SELECT model, -1, y, pred, sum(n) FROM ce GROUP BY ALL),
cf AS (SELECT model, draw, k, coalesce(2 * sum(CASE WHEN y = k AND pred = k THEN n END) / nullif(sum(CASE WHEN y = k THEN n ELSE 0 END) + sum(CASE WHEN pred = k THEN n ELSE 0 END), 0), 0) AS f, sum(CASE WHEN y = k THEN n ELSE 0 END) AS support, sum(CASE WHEN y = k AND pred = k THEN n ELSE 0 END) AS hit FROM dr, range(5) t(k) GROUP BY ALL)
SELECT model, draw, round(sum(f) / 5, 6) AS macro, round(sum(hit) / sum(support), 6) AS accuracy, count(*) FILTER (support > 0) AS classes FROM cf GROUP BY ALL"""),
    "locked_intervals": (lambda s, d: r(D.locked_intervals(_rare(s, d), K, 500, SEED)), None),
    "method_intervals": (lambda s, d: r(D.method_intervals(preds(s, d), K, 1000, SEED, "cand", "ref")), None),
    "comparison_figures": (lambda s, d: r(G.figures(_compared(s, d), K).select(*_FIG_NAMES)), f"{COMPARED}, {FIGURES} SELECT comparison, {_FIGS} FROM fi"),
    "locked_gate": (lambda s, d: r(G.locked_gate(_compared(s, d), K, BOOT, SEED).select("comparison", "low", "p_holm", "failed", "passed")),
        f"""{COMPARED}, {BOOTED}, {DELTAS}, {FIGURES}, iv AS ({_interval('de', 'comparison, ')}), h AS {_holm('iv', 'p_two_sided', 'p_holm')}
SELECT comparison, round(low, 6) AS low, round(p_holm, 6) AS p_holm, {_failed(_LOCKED)} AS failed, failed = '' AS passed FROM fi JOIN h USING (comparison)"""),
    "development_gate": (lambda s, d: r(gated(G.figures(_compared(s, d), K), G.development_checks()).select("comparison", "failed", "passed")),
        f"{COMPARED}, {FIGURES} SELECT comparison, {_failed(_DEVELOPMENT)} AS failed, failed = '' AS passed FROM fi"),
    "promotion_decisions": (lambda s, d: r(G.promotion(_compared(s, d), K, BOOT, SEED, 2)),
        f"""{COMPARED}, {BOOTED}, {DELTAS}, cd AS (SELECT comparison, draw, cls, fb - fa AS delta FROM cf), ma AS ({_interval('de', 'comparison, ')}), sp AS ({_interval('(SELECT * FROM cd WHERE cls = 2)', 'comparison, ')}),
mh AS {_holm('ma', 'p_two_sided', 'macro_holm')}, sh AS {_holm('sp', 'p_two_sided', 'special_holm')}, w AS (SELECT comparison, min(delta) AS class_gain FROM cd WHERE draw = -1 GROUP BY comparison)
SELECT comparison, round(mh.point, 6) AS macro_gain, round(macro_holm, 6) AS macro_holm, round(class_gain, 6) AS class_gain, round(sh.point, 6) AS special_gain, round(special_holm, 6) AS special_holm,
  mh.point >= 0.01 AND mh.low > 0 AND macro_holm <= 0.05 AND class_gain >= CAST(-0.02 AS DOUBLE) AS general, sh.point >= 0.02 AND sh.low > 0 AND special_holm <= 0.05 AND mh.point >= CAST(-0.005 AS DOUBLE) AS specialist
FROM mh JOIN sh USING (comparison) JOIN w USING (comparison)"""),
}
