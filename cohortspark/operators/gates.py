"""Figures of paired comparisons, and the promotion gates over them. One row per comparison.

Rows are (comparison, id, y, pred_a, pred_b, p_a, p_b, run): a the reference, b the candidate, ``run`` the seed or other
counterpart that both models share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import metrics as M
from cohortspark.operators import resample as H
from cohortspark.operators.select import gated, holm

BY = ("comparison",)


def _gains(pairs: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(by, cls, gain) of per-class F1; declared classes that don't occur are missing and gain nothing."""
    return H._scores(H.cells(pairs, None, by), k, by).select(*by, "cls", (F.col("f1_b") - F.col("f1_a")).alias("gain"))


def figures(pairs: DataFrame, k: int, by=BY) -> DataFrame:
    """(by, macro_gain, class_gain: the least of any class, nll_increase, brier_increase, rescued, harmed, net, runs, least_run_gain, least_run_net)."""
    by = list(by)
    whole = _gains(pairs, k, by).groupBy(*by).agg((F.sum("gain") / k).alias("macro_gain"), F.min("gain").alias("_g"), F.count("*").alias("_n"))
    whole = whole.select(*by, "macro_gain", F.when(F.col("_n") < k, F.least("_g", F.lit(0.0))).otherwise(F.col("_g")).alias("class_gain"))
    loss = lambda p: -F.ln(F.greatest(M.of_label(p), F.lit(M.EPS)))
    a, b = F.col("pred_a") == F.col("y"), F.col("pred_b") == F.col("y")
    turned = [F.count_if(~a & b).alias("rescued"), F.count_if(a & ~b).alias("harmed")]
    rows = pairs.groupBy(*by).agg(
        F.avg(loss("p_b") - loss("p_a")).alias("nll_increase"), F.avg(M.row_brier("p_b") - M.row_brier("p_a")).alias("brier_increase"), *turned
    ).withColumn("net", F.col("rescued") - F.col("harmed"))
    per_run = _gains(pairs, k, [*by, "run"]).groupBy(*by, "run").agg((F.sum("gain") / k).alias("gain"))
    net = pairs.groupBy(*by, "run").agg(*turned).select(*by, "run", (F.col("rescued") - F.col("harmed")).alias("run_net"))
    runs = per_run.join(net.hint("merge"), [*by, "run"]).groupBy(*by).agg(F.count("*").alias("runs"), F.min("gain").alias("least_run_gain"), F.min("run_net").alias("least_run_net"))
    return whole.join(rows.hint("merge"), by).join(runs.hint("merge"), by)


def locked_checks(low: float = 0.0, p: float = 0.05, class_drop: float = 0.02, nll: float = 0.02, brier: float = 0.01) -> dict[str, Column]:
    """The nine checks of a preselected nominee, over ``figures`` with ``low`` (of the group interval) and ``p_holm``."""
    return {
        "gain": F.col("macro_gain") > 0,
        "net": F.col("net") > 0,
        "interval": F.col("low") > low,
        "holm": F.col("p_holm") < p,
        "class_drop": F.col("class_gain") >= -class_drop,
        "nll": F.col("nll_increase") <= nll,
        "brier": F.col("brier_increase") <= brier,
        "runs_gain": F.col("least_run_gain") > 0,
        "runs_net": F.col("least_run_net") > 0,
    }


def development_checks(gain: float = 0.01, net: int = 1, runs: int = 3, class_drop: float = 0.02, nll: float = 0.02, brier: float = 0.01) -> dict[str, Column]:
    """The seven checks of a candidate under development, over ``figures``."""
    complete = F.col("runs") == runs
    return {
        "gain": F.col("macro_gain") >= gain,
        "net": F.col("net") >= net,
        "runs_gain": complete & (F.col("least_run_gain") > 0),
        "runs_net": complete & (F.col("least_run_net") > 0),
        "class_drop": F.col("class_gain") >= -class_drop,
        "nll": F.col("nll_increase") <= nll,
        "brier": F.col("brier_increase") <= brier,
    }


def locked_gate(pairs: DataFrame, k: int, draws: int, seed: object, by=BY, **limits) -> DataFrame:
    """``figures`` with the interval of the macro gain over groups, the Holm p over all comparisons, failed and passed."""
    boots = H.interval(H.deltas(H.cluster_draws(pairs, draws, seed, by=by), k, by), by=by).select(*by, "low", "p_two_sided")
    tests = holm(boots.withColumn("_all", F.lit(1)), ["_all"], "p_two_sided", by[0]).select(*by, "low", "p_holm")
    return gated(figures(pairs, k, by).join(tests.hint("merge"), list(by)), locked_checks(**limits))


def promotion(pairs: DataFrame, k: int, draws: int, seed: object, special: int, gain: float = 0.01, regression: float = 0.02, special_gain: float = 0.02, margin: float = 0.005, by=BY) -> DataFrame:
    """(by, macro_gain, macro_holm, class_gain, special_gain, special_holm, general, specialist): which candidates are promoted, and as what.

    General: enough macro gain, interval over 0, Holm p of 0.05 at most, no class worse by more than ``regression``. Specialist:
    the same of class ``special`` alone, with a macro F1 no more than ``margin`` worse.
    """
    by = list(by)
    drawn = H.cluster_draws(pairs, draws, seed, by=by)
    macro = H.interval(H.deltas(drawn, k, by), by=by).select(*by, F.col("point").alias("macro_gain"), F.col("low").alias("macro_low"), F.col("p_two_sided").alias("p"))
    classes = H.class_deltas(drawn, k, by)
    own = H.interval(classes.where(F.col("cls") == special), by=by).select(*by, F.col("point").alias("special_gain"), F.col("low").alias("special_low"), F.col("p_two_sided").alias("p"))
    worst = classes.where("draw = -1").groupBy(*by).agg(F.min("delta").alias("class_gain"))
    adjusted = lambda t, name: holm(t.withColumn("_all", F.lit(1)), ["_all"], "p", by[0]).withColumnRenamed("p_holm", name).drop("_all", "p")
    rows = adjusted(macro, "macro_holm").join(adjusted(own, "special_holm").hint("merge"), by).join(worst.hint("merge"), by)
    general = (F.col("macro_gain") >= gain) & (F.col("macro_low") > 0) & (F.col("macro_holm") <= 0.05) & (F.col("class_gain") >= -regression)
    specialist = (F.col("special_gain") >= special_gain) & (F.col("special_low") > 0) & (F.col("special_holm") <= 0.05) & (F.col("macro_gain") >= -margin)
    return rows.select(*by, "macro_gain", "macro_holm", "class_gain", "special_gain", "special_holm", general.alias("general"), specialist.alias("specialist"))
