"""Linear heads on feature vectors with Spark ML: single, factorised, out of fold, stacked; curves and screens.

Rows are (id, grp, y, features); ``features`` is an array column. A fit standardises with sample deviations and
penalises by 1 / (C * n), so C means the same at every size.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import metrics as M
from cohortspark.operators import newton as W
from cohortspark.operators import probs as P
from cohortspark.operators import splits as J
from cohortspark.operators.draws import confusion_scores, multinomial_sums
from cohortspark.operators.resample import interval
from cohortspark.sources.tables import materialize


class Head:
    """A fitted scaler and multinomial model."""

    def __init__(self, scaler, model, classes: int):
        self.scaler, self.model, self.classes = scaler, model, classes

    def predict(self, rows: DataFrame, column: str = "p") -> DataFrame:
        out = self.model.transform(self.scaler.transform(rows.withColumn("_v", array_to_vector("features"))))
        return out.withColumn(column, vector_to_array("_probability")).drop("_v", "_x", "_raw", "_probability", "_pred")

    @property
    def iterations(self) -> int:
        return self.model.summary.totalIterations if self.model.hasSummary else 0


def fit_head(rows: DataFrame, classes: int, c: float = 1.0, balanced: bool = False, max_iter: int = 100) -> Head:
    rows = rows.select("y", array_to_vector("features").alias("_v"))
    if balanced:
        rows = rows.join(F.broadcast(J.class_weights(rows, "y").select("y", "weight")), "y")
    scaler = StandardScaler(inputCol="_v", outputCol="_x", withMean=True).fit(rows)
    n = rows.count()
    lr = LogisticRegression(
        featuresCol="_x", labelCol="y", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_pred", family="multinomial",
        regParam=1 / (c * max(n, 1)), standardization=False, maxIter=max_iter, **({"weightCol": "weight"} if balanced else {}),
    )
    return Head(scaler, lr.fit(scaler.transform(rows)), classes)


def head_report(rows: DataFrame, classes: int, by=("split",), **how) -> DataFrame:
    """(by, n, accuracy, macro_f1, log_loss, iterations) of a head fitted on the train split."""
    head = fit_head(rows.where("split = 'train'"), classes, **how)
    out = materialize(M.with_prediction(head.predict(rows)).select(*by, "id", "y", "p", "pred", "conf"))
    return M.accuracy(out, by).join(M.macro_f1(out, classes, by).hint("merge"), list(by)).join(M.log_loss(out, by).hint("merge"), list(by)).withColumn("iterations", F.lit(head.iterations))


def fit_factorised(rows: DataFrame, **how):
    """Two heads: seated or not on all rows, moving or still on the others. Labels: 0 seated, 1 still, 2 moving. Returns a function that adds ``p``."""
    seated = fit_head(rows.withColumn("y", (F.col("y") == 0).cast("int")), 2, **how)
    moving = fit_head(rows.where("y > 0").withColumn("y", (F.col("y") == 2).cast("int")), 2, **how)

    def predict(x: DataFrame) -> DataFrame:
        out = moving.predict(seated.predict(x, "_s"), "_m")
        return out.withColumn("p", P.factorised(F.col("_s")[1], F.col("_m")[1])).drop("_s", "_m")

    return predict


def out_of_fold(rows: DataFrame, fit, folds: int, parallel: int = 4) -> DataFrame:
    """``rows`` (with a fold column) with ``p`` from heads that never saw the row's fold; folds are fitted side by side."""

    def one(k: int) -> DataFrame:
        return fit(rows.where(F.col("fold") != k))(rows.where(F.col("fold") == k))

    with ThreadPoolExecutor(parallel) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, range(folds)))


def flat(classes: int, **how):
    return lambda rows: fit_head(rows, classes, **how).predict


def cross_fit(rows: DataFrame, classes: int, folds: int = 3, group: str = "grp", **how) -> DataFrame:
    return out_of_fold(J.group_folds(rows, group, folds), flat(classes, **how), folds)


def stack(views: dict[str, DataFrame], classes: int, folds: int = 3, **how) -> DataFrame:
    """Out-of-fold probabilities of every view become the features of a head of their own, itself scored out of fold."""
    wide = None
    for name, rows in views.items():
        oof = cross_fit(rows, classes, folds, **how).select("id", "grp", "y", F.col("p").alias(name))
        wide = oof if wide is None else wide.join(oof.select("id", name).hint("merge"), "id")
    stacked = P.stack_features(wide, list(views)).select("id", "grp", "y", "features")
    return cross_fit(stacked, classes, folds, **how)


def svm_scores(rows: DataFrame, classes: int, folds: int = 3, c: float = 1.0) -> DataFrame:
    """One-vs-rest linear SVM (hinge loss) out of fold, its scores calibrated by a multinomial head, again out of fold."""

    def fit(train: DataFrame):
        x = train.select("y", array_to_vector("features").alias("_v"))
        scaler = StandardScaler(inputCol="_v", outputCol="_x", withMean=True).fit(x)
        svm = OneVsRest(classifier=LinearSVC(regParam=1 / (c * max(x.count(), 1)), maxIter=30), featuresCol="_x", labelCol="y", predictionCol="_pred", parallelism=4)
        model = svm.fit(scaler.transform(x))
        return lambda new: model.transform(scaler.transform(new.withColumn("_v", array_to_vector("features")))).withColumn("scores", vector_to_array("rawPrediction")).drop("_v", "_x", "rawPrediction", "_pred")

    raw = out_of_fold(J.group_folds(rows, "grp", folds), fit, folds)
    return out_of_fold(raw.withColumn("features", F.col("scores")).drop("scores"), flat(classes), folds)


def fit_calibrators(preds: DataFrame, classes: int, grid: list[float], folds: int = 3, balanced: tuple[bool, ...] = (False,), parallel: int = 4) -> dict[tuple[str, bool], tuple[W.Linear, float]]:
    """{(model, balanced): (head, C)} of every model: a head on centred logs of p, its C chosen by log loss over group folds, then fitted on all rows.

    Rows are (model, grp, y, p). All fits share their passes over the rows, of which equal ones of a fold are one with a count.
    """
    rows = materialize(preds.select(F.col("model").alias("group"), "grp", "y", "p"))
    models = [r["group"] for r in rows.select("group").distinct().orderBy("group").collect()]  # as many as are compared

    def dealt(m: str) -> DataFrame:
        return W.counted(J.group_folds(rows.where(F.col("group") == m), "grp", folds), ["group", "fold", "y", "p"])

    with ThreadPoolExecutor(parallel) as pool:
        each = list(pool.map(dealt, models))
    if not each:
        return {}
    rows = materialize(reduce(DataFrame.unionByName, each).select("group", "fold", "y", "n", P.centred_logs("p").alias("features")))
    heads = W.fit_heads(rows, classes, [(m, c, b, k) for m in models for c in grid for b in balanced for k in range(folds)])
    losses = W.held_out_losses(rows, heads, M.EPS)
    best = {(m, b): min(grid, key=lambda c: (losses[m, c, b], c)) for m in models for b in balanced}
    return {(m, b): (heads[m, c, b, -1], c) for (m, b), c in best.items()}


def fit_calibrator(preds: DataFrame, classes: int, grid: list[float], folds: int = 3, balanced: bool = False) -> tuple[W.Linear, float]:
    """(head, C) of the rows of one model, see ``fit_calibrators``."""
    return fit_calibrators(preds.withColumn("model", F.lit("")), classes, grid, folds, (balanced,))["", balanced]


def calibrated(head: W.Linear, preds: DataFrame) -> DataFrame:
    """``preds`` with the probabilities of a calibrator in place of p."""
    return head.predict(preds.withColumn("features", P.centred_logs("p")).drop("p")).drop("features")


def tuned_calibrator(preds: DataFrame, classes: int, grid: list[float], folds: int = 3) -> tuple[DataFrame, float]:
    """(calibrated rows, C) of the rows that the calibrator is fitted on."""
    head, best = fit_calibrator(preds, classes, grid, folds)
    return calibrated(head, preds), best


def fused_views(features: DataFrame, pairs: list[tuple[str, str]]) -> dict[str, DataFrame]:
    """Concatenated features of each pair of views; ``features`` has (id, view, features, …)."""
    out = {}
    for a, b in pairs:
        right = features.where(F.col("view") == b).select("id", F.col("features").alias("_f"))
        out[f"{a}+{b}"] = features.where(F.col("view") == a).join(right.hint("merge"), "id").withColumn("features", F.concat("features", "_f")).drop("_f", "view")
    return out


def augmented(views: DataFrame, classes: int, fit, condition: str = "perturbation", clean: str = "original") -> tuple[DataFrame, DataFrame]:
    """(mean, per condition): a head trained on every perturbation of the train rows; the others are scored under each and on average."""
    predict = fit(views.where("split = 'train'"))
    scored = predict(views.where("split <> 'train'"))
    return P.mean_over(scored, ("id", "y"), "geometric"), M.accuracy(M.with_prediction(scored), (condition,))


def learning_curve(rows: DataFrame, classes: int, sizes: list[float], seeds: list[int], **how) -> DataFrame:
    """(size, seed, accuracy, macro_f1) on the other rows of heads fitted on nested subsets of the train split.

    Sizes are numbers of rows, or shares of the train rows if they are at most 1 and not whole numbers of rows (1.0 is all of them).
    """
    rows = materialize(rows)
    train, test = rows.where("split = 'train'"), rows.where("split <> 'train'")
    if any(isinstance(x, float) for x in sizes):
        n = train.count()
        sizes = [max(1, round(x * n)) if isinstance(x, float) else x for x in sizes]
    parts = []
    for seed in seeds:
        subsets = J.nested_subsets(train, "y", sizes, seed).select("size", "id")
        for size in sizes:
            head = fit_head(train.join(subsets.where(F.col("size") == size).select("id").hint("merge"), "id", "left_semi"), classes, **how)
            out = M.with_prediction(head.predict(test)).withColumns({"size": F.lit(size), "seed": F.lit(seed)})
            parts.append(M.accuracy(out, ("size", "seed")).join(M.macro_f1(out, classes, ("size", "seed")).hint("merge"), ["size", "seed"]).select("size", "seed", "accuracy", "macro_f1"))
    return reduce(DataFrame.unionByName, parts)


def few_shot_curve(rows: DataFrame, classes: int, budgets: list[int], repeats: int, seed: object, **how) -> tuple[DataFrame, DataFrame]:
    """(draws, curve): heads fitted on few-shot draws of the train split and scored on the other rows.

    Draws are (budget, repeat, rows, accuracy, macro_f1); the curve has (budget, repeats, mean and sample deviation of both, mean rows).
    """
    rows = materialize(rows)
    train, test = rows.where("split = 'train'"), rows.where("split <> 'train'")
    taken = materialize(train.select("id", "grp", "y", "features").join(J.few_shot(train, "grp", "y", budgets, repeats, seed).hint("merge"), "grp"))
    sizes, parts = taken.groupBy("budget", "repeat").agg(F.count("*").alias("rows")), []
    for budget in budgets:
        for repeat in range(repeats):
            drawn = taken.where((F.col("budget") == budget) & (F.col("repeat") == repeat))
            parts.append(M.with_prediction(fit_head(drawn, classes, **how).predict(test)).select(F.lit(budget).alias("budget"), F.lit(repeat).alias("repeat"), "id", "y", "pred"))
    by = ["budget", "repeat"]
    every = materialize(reduce(DataFrame.unionByName, parts))
    draws = M.accuracy(every, by).select(*by, "accuracy").join(M.macro_f1(every, classes, by).hint("merge"), by).join(sizes.hint("merge"), by).select(*by, "rows", "accuracy", "macro_f1")
    figures = [f(c).alias(f"{n}_{c}") for c in ("accuracy", "macro_f1") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return draws, draws.groupBy("budget").agg(F.count("*").alias("repeats"), F.avg("rows").alias("mean_rows"), *figures)


def screen(rows: DataFrame, classes: int, grid: list[float], folds: int = 3) -> DataFrame:
    """(c, accuracy, macro_f1, balanced_accuracy) of each C over group folds."""
    folded = materialize(J.group_folds(rows, "grp", folds))
    parts = []
    for c in grid:
        out = M.with_prediction(out_of_fold(folded, flat(classes, c=c), folds)).withColumn("c", F.lit(c))
        figures = M.macro(M.per_class(M.confusion(out, classes, ("c",)), ("c",)), ("c",))
        parts.append(M.accuracy(out, ("c",)).join(figures.hint("merge"), "c").select("c", "accuracy", "macro_f1", "balanced_accuracy"))
    return reduce(DataFrame.unionByName, parts)


def refit(rows: DataFrame, classes: int, stored: DataFrame, tolerance: float = 1e-6, **how) -> tuple[DataFrame, DataFrame]:
    """(probabilities of a head fitted on all rows, gap): gap tells whether the train-split fit repeats the stored probabilities."""
    from cohortspark.operators.reports import probability_gap

    again = fit_head(rows.where("split = 'train'"), classes, **how).predict(rows)
    return fit_head(rows, classes, **how).predict(rows), probability_gap(again, stored, ["id"], tolerance)


def geometry_report(development: DataFrame, test: DataFrame, external: DataFrame, classes: int, merged: list[list[int]], draws: int, seed: int, folds: int = 5) -> DataFrame:
    """(candidate, domain, n, oof_macro_f1, accuracy, macro_f1, low, high, log_loss): a balanced head on geometry against the commonest class.

    The head is scored out of fold on ``development`` (stratified folds), fitted on all of it, then scored on ``test``, with a 95 % interval
    of macro F1 from rows drawn anew inside their class, and on ``external`` rows, whose labels are those of ``merged`` classes, as are its
    summed probabilities. Of classes equally common the first counts. Rows are (id, y, features).
    """
    dealt = materialize(J.stratified_folds(development, "y", folds, seed).select(F.lit("").alias("group"), "fold", F.col("y").cast("int").alias("y"), F.lit(1).alias("n"), "features"))
    heads = W.fit_heads(dealt, classes, [("", 1.0, True, k) for k in range(folds)])
    oof = M.with_prediction(reduce(DataFrame.unionByName, [heads["", 1.0, True, k].predict(dealt.where(F.col("fold") == k)) for k in range(folds)]))
    own = M.macro_f1(oof, classes, ()).select(F.lit("geometry").alias("candidate"), F.lit("source").alias("domain"), F.col("macro_f1").alias("oof_macro_f1"))
    head = heads["", 1.0, True, -1]
    common = development.groupBy("y").count().orderBy(F.desc("count"), "y").first()["y"]
    tested = materialize(M.with_prediction(head.predict(test)).select("y", "p", "pred"))
    other = M.with_prediction(head.predict(external).select("y", P.collapsed("p", merged).alias("p")))
    drawn = tested.groupBy("y", "pred").agg(F.count("*").alias("mass")).withColumn("n", F.lit(1))
    spread = interval(confusion_scores(multinomial_sums(drawn, ["y", "pred"], ["y", "pred"], draws, seed, "y", "mass"), classes, []), "macro")
    spread = spread.select(F.lit("geometry").alias("candidate"), F.lit("source").alias("domain"), "low", "high")
    parts = []
    for candidate, domain, rows, k in (("geometry", "source", tested, classes), ("majority", "source", tested.withColumn("pred", F.lit(common)), classes), ("geometry", "external", other, len(merged))):
        of = rows.withColumns({"candidate": F.lit(candidate), "domain": F.lit(domain)})
        by = ("candidate", "domain")
        loss = M.log_loss(of, by).select(*by, (F.col("log_loss") if candidate == "geometry" else F.lit(None).cast("double")).alias("log_loss"))
        parts.append(M.accuracy(of, by).select(*by, "n", "accuracy").join(M.macro_f1(of, k, by).hint("merge"), list(by)).join(loss.hint("merge"), list(by)).select(*by, "n", "accuracy", "macro_f1", "log_loss"))
    out = reduce(DataFrame.unionByName, parts).join(own.hint("merge"), ["candidate", "domain"], "left").join(spread.hint("merge"), ["candidate", "domain"], "left")
    return out.select("candidate", "domain", "n", "oof_macro_f1", "accuracy", "macro_f1", "low", "high", "log_loss")
