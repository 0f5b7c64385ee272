"""Registered queries: fitted heads. Checked by tests, not by SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import fields as B
from cohortspark.operators import adaptation as A
from cohortspark.operators import heads as Z
from cohortspark.operators import metrics as M
from cohortspark.operators import nested as N
from cohortspark.plans.q_metrics import r
from cohortspark.sources import fixtures as X
from cohortspark.sources.fixtures import CLASSES as K
from cohortspark.sources.tables import materialize, scratch_folder

LABELS = 3


def rows(s, d):
    """Vectors with three classes; half of the label's pull is added to the first components, so that heads have something to learn."""
    y = (F.col("label") % LABELS).cast("int")
    pull = lambda v, i: v.cast("double") + F.when(i == F.col("y"), 0.25).otherwise(0.0)
    return X.vectors(s, d).select(F.col("vec_id").alias("id"), "grp", "split", y.alias("y"), "features").withColumn("features", F.transform("features", pull))


def view(x, first: int, n: int):
    return x.withColumn("features", F.slice("features", first, n))


def scored(out, by=()):
    p = M.with_prediction(out)
    return r(M.accuracy(p, by).join(M.macro_f1(p, LABELS, by).hint("merge"), list(by)) if by else M.accuracy(p, ()).join(F.broadcast(M.macro_f1(p, LABELS, ()))))


def _box_rows(s, d):
    b = B.perturbed(B.clean_boxes(X.boxes(s, d)).where("eligible")).where("NOT too_small").select(
        F.col("person_id").alias("id"), F.col("image_id").alias("grp"), "split", (F.col("person_id") % 3).cast("int").alias("y"), "perturbation",
        F.array(F.col("px0") / F.col("w"), F.col("py0") / F.col("h"), F.col("px1") / F.col("w"), F.col("py1") / F.col("h"), "input_area").alias("features"),
    )
    return b


def _geometry(s, d):
    """Every fourth image is external; labels say whether a box is higher and whether it is wider than 100 pixels."""
    b = B.geometry(B.clean_boxes(X.boxes(s, d)).where("eligible"))
    y = F.when(F.col("pixel_height") > 100, 2).otherwise(0) + F.when(F.col("x1") - F.col("x0") > 100, 1).otherwise(0)
    x = b.select(F.col("person_id").alias("id"), F.col("image_id").alias("grp"), "split", y.cast("int").alias("y"), B.five_features("edge").alias("features"))
    x = materialize(x)  # the boxes' expressions are long, and every fit reads them
    own, other = x.where("grp % 4 <> 3"), x.where("grp % 4 = 3").withColumn("y", F.least("y", F.lit(2)))
    return Z.geometry_report(own.where("split <> 'test'"), own.where("split = 'test'"), other, 4, [[0], [1], [2, 3]], 500, 20260822)


def _calibrated(s, d):
    """Log loss on all other rows of each model before and after a calibrator that is fitted on its val rows."""
    rows = X.preds(s, d).select("model", "split", "id", "grp", "y", "p")
    told = Z.fit_calibrators(rows.where("split = 'val'"), K, [0.1, 10.0])
    by = ("model", "split")
    rest = materialize(rows.where("split <> 'val'").groupBy(*by, "y", "p").agg(F.count("*").alias("n")))  # equal rows are one with a count
    loss = (-F.sum(F.col("n") * F.ln(F.greatest(M.of_label(), F.lit(M.EPS)))) / F.sum("n")).alias("log_loss")
    after = reduce(DataFrame.unionByName, [Z.calibrated(head, rest.where(F.col("model") == m)).withColumn("c", F.lit(c)) for (m, _), (head, c) in told.items()])
    return r(rest.groupBy(*by).agg(loss).withColumnRenamed("log_loss", "before").join(after.groupBy(*by, "c").agg(loss).select(*by, "log_loss", "c").hint("merge"), list(by)))


def _ledger(s, d):
    families = {"flat": {"c=0.01": {"c": 0.01}, "c=1": {"c": 1.0}}, "factorised": {"c=1": {"c": 1.0}}}
    return r(N.nested_runs(rows(s, d), families, N.heads_of(LABELS), LABELS, scratch_folder(s))[0])


def _fused(s, d):
    x = rows(s, d)
    long = view(x, 1, 16).withColumn("view", F.lit("a")).unionByName(view(x, 17, 16).withColumn("view", F.lit("b")))
    return scored(Z.cross_fit(Z.fused_views(long, [("a", "b")])["a+b"], LABELS))


def _refit(s, d):
    x = rows(s, d)
    return r(Z.refit(x, LABELS, Z.fit_head(x.where("split = 'train'"), LABELS).predict(x))[1])


QUERIES = {
    "head_report": (lambda s, d: r(Z.head_report(rows(s, d), LABELS, balanced=True)), None),
    "factorised_head": (lambda s, d: scored(Z.fit_factorised(rows(s, d).where("split = 'train'"))(rows(s, d)), ("split",)), None),
    "cross_fit": (lambda s, d: scored(Z.cross_fit(rows(s, d), LABELS)), None),
    "factorised_cross_fit": (lambda s, d: scored(Z.out_of_fold(Z.J.group_folds(rows(s, d), "grp", 3), Z.fit_factorised, 3)), None),
    "probability_stack": (lambda s, d: scored(Z.stack({"a": view(rows(s, d), 1, 32), "b": view(rows(s, d), 33, 32)}, LABELS, 2)), None),
    "svm_head": (lambda s, d: scored(Z.svm_scores(rows(s, d), LABELS, 2)), None),
    "tuned_calibrator": (_calibrated, None),
    "nested_selection": (lambda s, d: r(N.nested(rows(s, d), LABELS, [0.01, 1.0])), None),
    "nested_ledger": (_ledger, None),
    "fused_views": (_fused, None),
    "augmented_head": (lambda s, d: r(Z.augmented(_box_rows(s, d), 3, Z.fit_factorised)[1]), None),
    "learning_curve": (lambda s, d: r(Z.learning_curve(rows(s, d), LABELS, [0.1, 0.5, 1.0], [42, 52])), None),
    "few_shot_curve": (lambda s, d: r(Z.few_shot_curve(rows(s, d), LABELS, [1, 5, 20], 2, 7)[1]), None),
    "geometry_baseline": (lambda s, d: r(_geometry(s, d)), None),
    "head_screen": (lambda s, d: r(Z.screen(rows(s, d), LABELS, [0.01, 1.0])), None),
    "final_refit": (_refit, None),
    "adaptation_table": (lambda s, d: r(A.adaptation_table(X.preds(s, d), K, [1 / K] * K, 500, 20260823, grid=(0.1, 10.0), folds=2)), None),
}
