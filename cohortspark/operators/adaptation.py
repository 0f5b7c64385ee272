"""Seven ways to adapt a model's probabilities, fitted on train rows and compared on val rows, with intervals against the unchanged ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators import heads as Z
from cohortspark.operators import metrics as M
from cohortspark.operators import probs as P
from cohortspark.operators.draws import confusion_scores, multinomial_sums
from cohortspark.operators.resample import interval
from cohortspark.sources.tables import materialize

#: Methods in order, with what they are fitted on: nothing, labelled train rows, or train rows without their labels.
ROLES = {
    "unchanged": "source", "temperature": "supervised calibration", "em_priors": "unlabelled adaptation", "train_priors": "supervised decision",
    "offsets": "supervised decision", "calibrator": "supervised calibration", "balanced_calibrator": "supervised calibration",
}
FORM = ["model", "method", "split", "id", "grp", "y", "p"]


def fits(train: DataFrame, classes: int, source: list[float]) -> DataFrame:
    """(model, temperature, em, seen, offsets, settled) of train rows: a row per model, written. ``offsets`` are of classes 1 and 2."""
    temperature = P.fit_temperature(train).select("model", "temperature")
    em = P.priors_by(train, source).select("model", F.col("priors").alias("em"), "settled")
    n = [F.count_if(F.col("y") == k) / F.count("*") for k in range(classes)]
    seen = train.groupBy("model").agg(F.array(*n).alias("seen"))
    free = [F.lit(0.0), F.col("o1"), F.col("o2"), *[F.lit(0.0)] * (classes - 3)][:classes]
    offsets = P.search_offsets(train, classes, by=("model",)).select("model", F.array(*free).alias("offsets"))
    return materialize(reduce(lambda a, b: a.join(b.hint("merge"), "model"), [temperature, em, seen, offsets]))


def _other_priors(target: str, source: list[float]) -> Column:
    ratio = F.zip_with(target, F.array(*[F.lit(max(s, 1e-12)) for s in source]), lambda t, s: t / s)
    return P.normalised(F.zip_with("p", ratio, lambda v, r: v * r))


def adapted(preds: DataFrame, classes: int, source: list[float], grid: list[float] = (0.1, 1.0, 10.0), folds: int = 3, parallel: int = 4) -> DataFrame:
    """(model, method, split, id, grp, y, p) of the train and val rows under every method, seven rows for each.

    Rows are (model, split, id, grp, y, p). Nothing is fitted on val rows. ``source`` are the class priors that the models were trained under.
    """
    rows = materialize(preds.where(F.col("split").isin("train", "val")).select("model", "split", "id", "grp", "y", "p"))
    train = rows.where("split = 'train'")
    told = fits(train, classes, source)
    models = [r["model"] for r in told.select("model").orderBy("model").collect()]  # as many as are compared
    shifted = P.normalised(F.zip_with(F.transform("p", lambda v: F.greatest(v, F.lit(1e-12))), "offsets", lambda v, o: v * F.exp(o)))
    ways = {
        "unchanged": F.col("p"), "temperature": P.with_temperature("p", F.col("temperature")), "em_priors": _other_priors("em", source),
        "train_priors": _other_priors("seen", source), "offsets": shifted,
    }
    way = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), p.alias("p")) for n, p in ways.items()])).alias("w")
    simple = rows.join(F.broadcast(told), "model").select("model", "split", "id", "grp", "y", way).select("model", "w.method", "split", "id", "grp", "y", "w.p")  # a row per model is sent

    heads = Z.fit_calibrators(train, classes, list(grid), folds, (False, True), parallel)

    def calibrate(model: str, balanced: bool) -> DataFrame:
        name = "balanced_calibrator" if balanced else "calibrator"
        return Z.calibrated(heads[model, balanced][0], rows.where(F.col("model") == model)).withColumn("method", F.lit(name)).select(*FORM)

    return reduce(DataFrame.unionByName, [calibrate(m, b) for m in models for b in (False, True)], simple)


def gains(rows: DataFrame, classes: int, draws: int, seed: int, base: str = "unchanged", group: str = "grp") -> DataFrame:
    """(model, method, gain, gain_low, gain_high, p_positive, draws): macro F1 less that of ``base``, groups drawn anew as a whole.

    All methods and models meet the same draws, so the differences are paired. Rows are (model, method, group, y, pred).
    """
    counts = rows.groupBy(group, "model", "method", "y", "pred").agg(F.count("*").alias("n"))
    drawn = materialize(confusion_scores(multinomial_sums(counts, [group], ["model", "method", "y", "pred"], draws, seed), classes, ["model", "method"]).select("model", "method", "draw", "macro"))
    of_base = drawn.where(F.col("method") == base).select("model", "draw", F.col("macro").alias("_b"))
    both = drawn.join(of_base.hint("merge"), ["model", "draw"]).withColumn("delta", F.col("macro") - F.col("_b"))
    out = interval(both, by=("model", "method"))
    return out.select("model", "method", F.col("point").alias("gain"), F.col("low").alias("gain_low"), F.col("high").alias("gain_high"), "p_positive", "draws")


def adaptation_table(preds: DataFrame, classes: int, source: list[float], draws: int, seed: int, **how) -> DataFrame:
    """(model, method, role, n, accuracy, macro_f1, log_loss of train and of val, gain with its interval, place) of all models and methods.

    Places go by macro F1 on val, then log loss, model and method. An empty table gives no row; a model needs train and val rows.
    """
    rows = materialize(M.with_prediction(adapted(preds, classes, source, **how)))
    by = ["model", "method"]

    def figures(split: str) -> DataFrame:
        of = rows.where(F.col("split") == split)
        out = M.accuracy(of, by).join(M.macro_f1(of, classes, by).hint("merge"), by).join(M.log_loss(of, by).hint("merge"), by)
        return out.select(*by, *[F.col(c).alias(f"{split}_{c}") for c in ("n", "accuracy", "macro_f1", "log_loss")])

    out = figures("train").join(figures("val").hint("merge"), by).join(gains(rows.where("split = 'val'"), classes, draws, seed).hint("merge"), by)
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("method")]
    order = Window.orderBy(F.desc(F.round("val_macro_f1", 9)), F.round("val_log_loss", 9), "model", "method")  # a row per model and method
    return out.withColumn("role", role).withColumn("place", F.row_number().over(order))
