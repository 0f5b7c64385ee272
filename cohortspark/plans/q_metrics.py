"""Registered queries: prediction metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions.fields import rounded
from cohortspark.operators import metrics as M
from cohortspark.sources.fixtures import CLASSES as K
from cohortspark.sources.fixtures import PREDS, preds


def r(df, *keep):
    """Doubles to six places."""
    return df.select(*[rounded(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def q(f):
    return lambda spark, sf: r(f(preds(spark, sf)))


CELLS = f"""WITH {PREDS},
grid AS (SELECT model, y.y, p.pred FROM (SELECT DISTINCT model FROM preds), (SELECT unnest(range(5)) AS y) y, (SELECT unnest(range(5)) AS pred) p),
cnt AS (SELECT model, y, pred, count(*) AS n FROM preds GROUP BY ALL),
cells AS (SELECT g.model, g.y, g.pred, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN cnt c ON c.model = g.model AND c.y = g.y AND c.pred = g.pred)"""
CLASSES_SQL = f"""{CELLS},
cl AS (SELECT model, k AS cls, sum(CASE WHEN y = k THEN n ELSE 0 END) AS support, sum(CASE WHEN pred = k THEN n ELSE 0 END) AS predicted, sum(CASE WHEN y = k AND pred = k THEN n ELSE 0 END) AS tp
  FROM cells, range(5) t(k) GROUP BY model, k),
pc AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM cl)"""
RANKED = f"""WITH {PREDS}, rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY conf DESC, id) AS rank, count(*) OVER (PARTITION BY model) AS n_all,
  sum(CASE WHEN y <> pred THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY conf DESC, id ROWS UNBOUNDED PRECEDING) AS e FROM preds)"""
PAIR = f"""WITH {PREDS}, pr AS (SELECT a.id, a.y, a.grp, a.split, a.price, a.pred AS pa, b.pred AS pb, a.p AS p_a, b.p AS p_b FROM preds a JOIN preds b ON a.id = b.id AND a.model = 'ref' AND b.model = 'cand')"""
OVR = f"""WITH {PREDS}, ov AS (SELECT model, id, k AS cls, p[k + 1] AS score, CASE WHEN y = k THEN 1 ELSE 0 END AS hit FROM preds, range(5) t(k))"""
_BIN = "least(floor({0} * 15), 14)"
AUROC = """SELECT {by}, sum(pos * (coalesce(nb, 0) + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM
  (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM
    (SELECT {by}, score, sum(hit) AS pos, sum(1 - hit) AS neg FROM {rows} GROUP BY ALL)) GROUP BY {by}"""


def transitions_sql(by: str = "", rows: str = "pr") -> str:
    g = f"{by}, " if by else ""
    return f"""SELECT *, rescued - harmed AS net, round(CASE WHEN rescued + harmed + both_wrong > 0 THEN both_wrong / (rescued + harmed + both_wrong) ELSE 1 END, 6) AS jaccard,
  round(disagreements / n, 6) AS disagreement, round(rescued / nullif(rescued + both_wrong, 0), 6) AS rescue_rate, round(harmed / nullif(harmed + both_right, 0), 6) AS harm_rate
FROM (SELECT {g}count(*) AS n, count(*) FILTER (pa <> y AND pb = y) AS rescued, count(*) FILTER (pa = y AND pb <> y) AS harmed, count(*) FILTER (pa = y AND pb = y) AS both_right,
  count(*) FILTER (pa <> y AND pb <> y) AS both_wrong, count(*) FILTER (pa <> pb) AS disagreements FROM {rows} {"GROUP BY " + by if by else ""})"""


QUERIES = {
    "confusion_counts": (q(lambda p: M.confusion(p, K)), f"{CELLS} SELECT *, round(CASE WHEN t > 0 THEN n / t ELSE 0 END, 6) AS row_share FROM (SELECT *, sum(n) OVER (PARTITION BY model, y) AS t FROM cells)".replace("SELECT *, round", "SELECT model, y, pred, n, round")),
    "accuracy": (q(M.accuracy), f"WITH {PREDS} SELECT model, count(*) AS n, count(*) FILTER (y <> pred) AS errors, round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END), 6) AS accuracy FROM preds GROUP BY model"),
    "per_class_f1": (q(lambda p: M.per_class(M.confusion(p, K))), f'{CLASSES_SQL} SELECT model, cls, support, predicted, tp, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc'),
    "macro_metrics": (
        q(lambda p: M.macro(M.per_class(M.confusion(p, K)))),
        f'{CLASSES_SQL} SELECT model, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg("precision"), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall FROM pc GROUP BY model',
    ),
    "macro_observed": (
        q(lambda p: M.macro(M.per_class(M.confusion(p.where("y <> 4 AND pred <> 4"), K)), over="observed").select("model", "macro_f1")),
        f"""{CLASSES_SQL.replace("FROM preds GROUP BY ALL", "FROM preds WHERE y <> 4 AND pred <> 4 GROUP BY ALL")} SELECT model, round(avg(f1), 6) AS macro_f1 FROM pc WHERE support + predicted > 0 GROUP BY model""",
    ),
    "log_loss": (q(M.log_loss), f"WITH {PREDS} SELECT model, round(-avg(ln(greatest(p[y + 1], 2.220446049250313e-16))), 6) AS log_loss FROM preds GROUP BY model"),
    "brier": (q(M.brier), f"WITH {PREDS} SELECT model, round(sum(power(p[k + 1] - CASE WHEN y = k THEN 1 ELSE 0 END, 2)) / count(DISTINCT id), 6) AS brier FROM preds, range(5) t(k) GROUP BY model"),
    "reliability_15": (q(lambda p: M.reliability(p)), f"WITH {PREDS} SELECT model, CAST({_BIN.format('conf')} AS INT) AS bin, count(*) AS n, round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(conf), 6) AS confidence FROM preds GROUP BY ALL"),
    "ece_15": (
        q(lambda p: M.calibration_error(M.reliability(p))),
        f"WITH {PREDS} SELECT model, round(sum(abs(a - c) * n) / sum(n), 6) AS ece, round(max(abs(a - c)), 6) AS mce FROM (SELECT model, {_BIN.format('conf')} AS bin, count(*) AS n, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS a, avg(conf) AS c FROM preds GROUP BY ALL) GROUP BY model",
    ),
    "adaptive_ece_15": (
        q(M.adaptive_calibration_error),
        f"WITH {PREDS} SELECT model, round(sum(abs(a - c) * n) / sum(n), 6) AS adaptive_ece FROM (SELECT model, bin, count(*) AS n, avg(CASE WHEN y = pred THEN 1.0 ELSE 0 END) AS a, avg(conf) AS c FROM (SELECT *, ntile(15) OVER (PARTITION BY model ORDER BY conf, id) AS bin FROM preds) GROUP BY ALL) GROUP BY model",
    ),
    "classwise_ece": (
        q(M.classwise_calibration_error),
        f"{OVR} SELECT model, round(avg(e), 6) AS classwise_ece FROM (SELECT model, cls, sum(abs(a - c) * n) / sum(n) AS e FROM (SELECT model, cls, {_BIN.format('score')} AS bin, count(*) AS n, avg(hit) AS a, avg(score) AS c FROM ov GROUP BY ALL) GROUP BY model, cls) GROUP BY model",
    ),
    "risk_coverage_ceil": (q(lambda p: M.risk_coverage(p, [1.0, 0.9, 0.8, 0.5])), f"{RANKED} SELECT model, c AS coverage, rank AS retained, round(conf, 6) AS threshold, round(1 - e / rank, 6) AS accuracy, round(e / rank, 6) AS risk FROM rk, (SELECT unnest([1.0, 0.9, 0.8, 0.5]::DOUBLE[]) AS c) WHERE rank = greatest(ceil(c * n_all), 1)"),
    "risk_coverage_floor": (q(lambda p: M.risk_coverage(p, [0.95, 0.75, 0.25], rule="floor")), f"{RANKED} SELECT model, c AS coverage, rank AS retained, round(conf, 6) AS threshold, round(1 - e / rank, 6) AS accuracy, round(e / rank, 6) AS risk FROM rk, (SELECT unnest([0.95, 0.75, 0.25]::DOUBLE[]) AS c) WHERE rank = floor(c * n_all)"),
    "aurc": (q(M.aurc), f"{RANKED} SELECT model, round(avg(e / rank), 6) AS aurc FROM rk GROUP BY model"),
    "selective_macro_f1": (
        q(lambda p: M.selective_macro(p, K, 0.8)),
        CLASSES_SQL.replace("cnt AS (SELECT model, y, pred, count(*) AS n FROM preds GROUP BY ALL)", "rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY conf DESC, id) AS rank, count(*) OVER (PARTITION BY model) AS n_all FROM preds), cnt AS (SELECT model, y, pred, count(*) AS n FROM rk WHERE rank <= ceil(CAST(0.8 AS DOUBLE) * n_all) GROUP BY ALL)") + " SELECT model, round(avg(f1), 6) AS macro_f1 FROM pc GROUP BY model",
    ),
    "ranked_prefix": (
        q(lambda p: M.ranked(p).select("model", "id", "rank", "errors_so_far", "n_all")),
        f"{RANKED} SELECT model, id, rank, e AS errors_so_far, n_all FROM rk",
    ),
    "confidence_summary": (
        q(M.confidence_summary),
        f"WITH {PREDS} SELECT model, round(avg(conf), 6) AS mean_confidence, round(avg(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2]), 6) AS mean_margin, round(avg(-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END))), 6) AS mean_entropy, round(avg(conf) FILTER (y = pred), 6) AS confidence_right, round(avg(conf) FILTER (y <> pred), 6) AS confidence_wrong FROM preds GROUP BY model",
    ),
    "error_transitions": (q(lambda p: M.transitions(M.paired(p, "ref", "cand"))), f"{PAIR} {transitions_sql()}"),
    "transitions_by_split": (q(lambda p: M.transitions(M.paired(p, "ref", "cand", ["split"]), ["split"])), f"{PAIR} {transitions_sql('split')}"),
    "complementarity": (
        q(lambda p: M.complementarity(M.paired(p, "ref", "cand"))),
        f"""{PAIR} SELECT round(avg(CASE WHEN pa <> pb THEN 1.0 ELSE 0 END), 6) AS disagreement, round(avg(CASE WHEN pa <> y AND pb <> y THEN 1.0 ELSE 0 END), 6) AS double_fault, round(avg(CASE WHEN pa = y OR pb = y THEN 1.0 ELSE 0 END), 6) AS oracle_accuracy,
  count(*) FILTER (pa = y AND pb <> y) AS only_a, count(*) FILTER (pa <> y AND pb = y) AS only_b, (SELECT round(corr(p_a[k + 1], p_b[k + 1]), 6) FROM pr, range(5) t(k)) AS correlation FROM pr""",
    ),
    "binary_auroc": (
        q(lambda p: M.auroc(p.select("model", F.col("conf").alias("score"), (F.col("y") == F.col("pred")).cast("int").alias("hit")), ["model"])),
        f"WITH {PREDS}, sc AS (SELECT model, conf AS score, CASE WHEN y = pred THEN 1 ELSE 0 END AS hit FROM preds) SELECT model, round(auroc, 6) AS auroc FROM ({AUROC.format(by='model', rows='sc')})",
    ),
    "macro_auc": (
        q(M.macro_auc),
        f"""{OVR}, ro AS ({AUROC.format(by='model, cls', rows='ov')}),
ap AS (SELECT model, cls, sum(pos * cp / cn) / nullif(sum(pos), 0) AS ap FROM (SELECT *, sum(pos) OVER (PARTITION BY model, cls ORDER BY score DESC) AS cp, sum(n) OVER (PARTITION BY model, cls ORDER BY score DESC) AS cn FROM
  (SELECT model, cls, score, sum(hit) AS pos, count(*) AS n FROM ov GROUP BY ALL)) GROUP BY model, cls)
SELECT model, round(CASE WHEN count(auroc) = count(*) THEN avg(auroc) END, 6) AS macro_auroc, round(CASE WHEN count(ap) = count(*) THEN avg(ap) END, 6) AS macro_average_precision FROM ro JOIN ap USING (model, cls) GROUP BY model""",
    ),
    "merged_class_f1": (
        q(lambda p: M.merged_f1(p, [[0, 1], [2, 3, 4]])),
        f"""WITH {PREDS}, b AS (SELECT model, CASE WHEN y < 2 THEN 0 ELSE 1 END AS y, CASE WHEN pred < 2 THEN 0 ELSE 1 END AS pred FROM preds),
f AS (SELECT model, k, 2 * count(*) FILTER (y = k AND pred = k) / nullif(count(*) FILTER (y = k) + count(*) FILTER (pred = k), 0) AS f1 FROM b, range(2) t(k) GROUP BY model, k)
SELECT model, round(avg(coalesce(f1, 0)), 6) AS macro_f1 FROM f GROUP BY model""",
    ),
    "ks_statistic": (
        q(lambda p: M.ks_statistic(p.where("model = 'ref'").withColumn("early", F.col("yr") < 1996), "price", "early")),
        """WITH c AS (SELECT o_totalprice AS v, count(*) FILTER (year(o_orderdate) < 1996) AS a, count(*) FILTER (year(o_orderdate) >= 1996) AS b FROM orders GROUP BY 1)
SELECT round(max(abs(ca / ta - cb / tb)), 6) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM c)""",
    ),
    "ks_test": (
        q(lambda p: M.ks_test(p.where("model = 'ref'").withColumn("early", F.col("yr") < 1996), "price", "early", ["split"])),
        """WITH o AS (SELECT CASE WHEN o_custkey % 10 < 7 THEN 'train' WHEN o_custkey % 10 < 8 THEN 'val' ELSE 'test' END AS split, o_totalprice AS v, year(o_orderdate) < 1996 AS early FROM orders),
c AS (SELECT split, v, count(*) FILTER (early) AS a, count(*) FILTER (NOT early) AS b FROM o GROUP BY ALL),
k AS (SELECT split, max(abs(ca / ta - cb / tb)) AS ks, max(ta) AS n_a, max(tb) AS n_b FROM (SELECT split, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY split) AS ta, sum(b) OVER (PARTITION BY split) AS tb FROM c WINDOW w AS (PARTITION BY split ORDER BY v)) GROUP BY split),
x AS (SELECT *, ks * sqrt(n_a * n_b / (n_a + n_b)) AS x FROM k)
SELECT split, round(ks, 6) AS ks, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(CASE WHEN x < 1 THEN 1 - sqrt(2 * pi()) / x * list_sum(list_transform(range(1, 41), lambda i: exp(-power(2 * i - 1, 2) * pi() * pi() / 8 / (x * x))))
  ELSE 2 * list_sum(list_transform(range(1, 41), lambda i: CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * i * i * x * x))) END, 6) AS p FROM x""",
    ),
    "spearman_test": (q(lambda p: M.spearman_test(p, "conf", "price", ["model", "split"]).select("model", "split", "n", "spearman", "p")), None),
    "spearman_by_model": (
        q(lambda p: M.spearman(p, "conf", "price", ["model"])),
        f"""WITH {PREDS}, k AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY conf) + (count(*) OVER (PARTITION BY model, conf) - 1) / 2 AS a, rank() OVER (PARTITION BY model ORDER BY price) + (count(*) OVER (PARTITION BY model, price) - 1) / 2 AS b FROM preds)
SELECT model, count(*) AS n, round(corr(a, b), 6) AS spearman FROM k GROUP BY model""",
    ),
}
