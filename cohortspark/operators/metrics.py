"""Prediction metrics over rows (…, id, y, p, pred, conf): every function groups by ``by`` and returns one row per group.

``y`` and ``pred`` are class numbers from 0, ``p`` an array of K probabilities. Most metrics go through the K * K
confusion counts or a few row-level scalars, so what is shuffled doesn't grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.special import kolmogorov_tail, t_two_sided
from cohortspark.operators.order import running

BY = ("model",)
EPS = 2.220446049250313e-16


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant (``corr`` divides by zero there)."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread))


def with_prediction(preds: DataFrame) -> DataFrame:
    """Adds ``pred`` (first class of the largest probability) and ``conf`` (that probability)."""
    return preds.withColumn("pred", (F.array_position("p", F.array_max("p")) - 1).cast("int")).withColumn("conf", F.array_max("p"))


def confusion(preds: DataFrame, k: int, by=BY, weight: Column | None = None) -> DataFrame:
    """(by, y, pred, n, row_share): the whole K * K grid, zeros too; row_share is n over the class's total, 0 if that is 0."""
    counts = preds.groupBy(*by, "y", "pred").agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    known = counts.where(F.col("y").between(0, k - 1) & F.col("pred").between(0, k - 1))
    packed = known.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * k + F.col("pred")).cast("int"), "n"))).alias("_m"))  # k * k entries at most
    cell = F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("_c")
    full = packed.select(*by, "_m", cell).select(
        *by, F.floor(F.col("_c") / k).cast("int").alias("y"), (F.col("_c") % k).alias("pred"), F.coalesce(F.try_element_at("_m", "_c"), F.lit(0)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy(*by, "y"))
    return full.withColumn("row_share", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def per_class(cells: DataFrame, by=BY) -> DataFrame:
    """(by, cls, support, predicted, tp, precision, recall, f1) from confusion counts (by, y, pred, n); 0 where a denominator is 0."""
    right = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0)
    as_y = cells.select(*by, F.col("y").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), right.alias("tp"))
    as_pred = cells.select(*by, F.col("pred").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp"))
    out = as_y.unionByName(as_pred).groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.select(
        "*",
        share("tp", "predicted").alias("precision"),
        share("tp", "support").alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0)).alias("f1"),
    )


def macro(classes: DataFrame, by=BY, over: str = "declared") -> DataFrame:
    """(by, macro_f1, weighted_f1, balanced_accuracy, macro_precision, macro_recall) from per-class rows.

    ``over`` "declared" averages all classes of the grid, "observed" those with a label or a prediction. Balanced
    accuracy averages the recall of classes with labels.
    """
    rows = classes if over == "declared" else classes.where("support + predicted > 0")
    return rows.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
    )


def macro_f1(preds: DataFrame, k: int, by=BY) -> DataFrame:
    return macro(per_class(confusion(preds, k, by), by), by).select(*by, "macro_f1")


def accuracy(preds: DataFrame, by=BY) -> DataFrame:
    wrong = (F.col("y") != F.col("pred")).cast("int")
    return preds.groupBy(*by).agg(F.count("*").alias("n"), F.sum(wrong).alias("errors"), (1 - F.avg(wrong)).alias("accuracy"))


def of_label(p: str = "p") -> Column:
    return F.element_at(p, F.col("y") + 1)


def log_loss(preds: DataFrame, by=BY) -> DataFrame:
    return preds.groupBy(*by).agg((-F.avg(F.ln(F.greatest(of_label(), F.lit(EPS))))).alias("log_loss"))


def row_brier(p: str = "p") -> Column:
    gap = F.transform(p, lambda v, i: F.pow(v - F.when(i == F.col("y"), 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(gap, F.lit(0.0), lambda a, v: a + v)


def brier(preds: DataFrame, by=BY) -> DataFrame:
    """Sum over classes of squared gaps, mean over rows."""
    return preds.groupBy(*by).agg(F.avg(row_brier()).alias("brier"))


def reliability(rows: DataFrame, bins: int = 15, by=BY, score: str = "conf", hit: Column | None = None) -> DataFrame:
    """(by, bin, n, accuracy, confidence) over equal-width bins; the last bin is closed."""
    hit = (F.col("y") == F.col("pred")) if hit is None else hit
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("accuracy"), F.avg(score).alias("confidence"))


def calibration_error(bins: DataFrame, by=BY) -> DataFrame:
    """(by, ece, mce) from reliability rows: weighted mean and maximum of the gap between accuracy and confidence."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return bins.groupBy(*by).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def ranked(preds: DataFrame, by=BY, score: str = "conf") -> DataFrame:
    """Adds rank (score descending, id ascending), group size n_all and running count of errors, without a window over a whole group."""
    wrong = (F.col("y") != F.col("pred")).cast("long")
    return running(preds, by, [F.desc(score), F.asc("id")], {"rank": F.lit(1), "errors_so_far": wrong}, totals=True).withColumnRenamed("rank_all", "n_all").drop("errors_so_far_all")


def adaptive_calibration_error(preds: DataFrame, bins: int = 15, by=BY) -> DataFrame:
    """ECE over bins of equal counts in order of rising confidence, then id; the first n % bins bins have one row more."""
    rows = preds.select(*by, "id", "conf", (F.col("y") == F.col("pred")).cast("double").alias("hit"))
    rows = running(rows, by, [F.asc("conf"), F.asc("id")], {"rank": F.lit(1)}, totals=True)
    n, r = F.col("rank_all"), F.col("rank") - 1
    size, extra = F.floor(n / bins), n % bins
    at = F.when(r < extra * (size + 1), F.floor(r / (size + 1))).otherwise(extra + F.floor((r - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    binned = rows.withColumn("bin", at).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("conf").alias("confidence"))
    return calibration_error(binned, by).select(*by, F.col("ece").alias("adaptive_ece"))


def one_vs_rest(preds: DataFrame, by=BY) -> DataFrame:
    """(by, cls, id, score, hit): a row per class."""
    return preds.select(*by, "id", "y", F.posexplode("p").alias("cls", "score")).withColumn("hit", (F.col("y") == F.col("cls")).cast("int"))


def classwise_calibration_error(preds: DataFrame, bins: int = 15, by=BY) -> DataFrame:
    rows = reliability(one_vs_rest(preds, by), bins, (*by, "cls"), "score", F.col("hit") == 1)
    return calibration_error(rows, (*by, "cls")).groupBy(*by).agg(F.avg("ece").alias("classwise_ece"))


def risk_coverage(preds: DataFrame, coverages: list[float], by=BY, rule: str = "ceil") -> DataFrame:
    """(by, coverage, retained, threshold, accuracy, risk): the ceil (at least 1) or floor of coverage * n most confident rows."""
    wanted = F.explode(F.array(*[F.lit(float(c)) for c in coverages])).alias("coverage")
    take = F.greatest(F.ceil(F.col("coverage") * F.col("n_all")), F.lit(1)) if rule == "ceil" else F.floor(F.col("coverage") * F.col("n_all"))
    last = ranked(preds.select(*by, "id", "y", "pred", "conf"), by).select("*", wanted).where(F.col("rank") == take)
    return last.select(
        *by, "coverage", F.col("rank").alias("retained"), F.col("conf").alias("threshold"), (1 - F.col("errors_so_far") / F.col("rank")).alias("accuracy"), (F.col("errors_so_far") / F.col("rank")).alias("risk")
    )


def aurc(preds: DataFrame, by=BY) -> DataFrame:
    """Mean over all coverages of the error rate among the rows kept."""
    return ranked(preds.select(*by, "id", "y", "pred", "conf"), by).groupBy(*by).agg(F.avg(F.col("errors_so_far") / F.col("rank")).alias("aurc"))


def selective_macro(preds: DataFrame, k: int, coverage: float, by=BY) -> DataFrame:
    kept = ranked(preds.select(*by, "id", "y", "pred", "conf"), by).where(F.col("rank") <= F.greatest(F.ceil(F.lit(coverage) * F.col("n_all")), F.lit(1)))
    return macro_f1(kept, k, by)


def confidence_summary(preds: DataFrame, by=BY) -> DataFrame:
    top = F.sort_array("p", asc=False)
    entropy = F.aggregate("p", F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.ln(v)).otherwise(0.0))
    right = F.col("y") == F.col("pred")
    return preds.groupBy(*by).agg(
        F.avg("conf").alias("mean_confidence"),
        F.avg(top[0] - top[1]).alias("mean_margin"),
        F.avg(entropy).alias("mean_entropy"),
        F.avg(F.when(right, F.col("conf"))).alias("confidence_right"),
        F.avg(F.when(~right, F.col("conf"))).alias("confidence_wrong"),
    )


def paired(preds: DataFrame, reference: str, candidate: str, extra=()) -> DataFrame:
    """One row per id: y, pred and p of both models (suffix _a the reference, _b the candidate)."""
    a, b = (preds.where(F.col("model") == m).select("id", "y", "grp", *extra, F.col("pred").alias(f"pred_{x}"), F.col("p").alias(f"p_{x}")) for m, x in ((reference, "a"), (candidate, "b")))
    return a.join(b.select("id", "pred_b", "p_b").hint("merge"), "id")


def transitions(pairs: DataFrame, by=()) -> DataFrame:
    """Rescued, harmed, net, both right and wrong, Jaccard of the error sets (1 if both are empty), disagreement, conditional rates (null without a case)."""
    a, b = F.col("pred_a") == F.col("y"), F.col("pred_b") == F.col("y")
    n = lambda c, name: F.count_if(c).alias(name)
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), n(~a & b, "rescued"), n(a & ~b, "harmed"), n(a & b, "both_right"), n(~a & ~b, "both_wrong"), n(F.col("pred_a") != F.col("pred_b"), "disagreements")
    )
    union = F.col("rescued") + F.col("harmed") + F.col("both_wrong")
    return (
        out.withColumn("net", F.col("rescued") - F.col("harmed"))
        .withColumn("jaccard", F.when(union > 0, F.col("both_wrong") / union).otherwise(1.0))
        .withColumn("disagreement", F.col("disagreements") / F.col("n"))
        .withColumn("rescue_rate", F.try_divide(F.col("rescued"), F.col("rescued") + F.col("both_wrong")))
        .withColumn("harm_rate", F.try_divide(F.col("harmed"), F.col("harmed") + F.col("both_right")))
    )


def complementarity(pairs: DataFrame) -> DataFrame:
    """Disagreement, double faults, oracle accuracy, rows only one of two models gets right, correlation of all probabilities."""
    a, b = F.col("pred_a") == F.col("y"), F.col("pred_b") == F.col("y")
    rows = pairs.agg(
        F.avg((F.col("pred_a") != F.col("pred_b")).cast("double")).alias("disagreement"),
        F.avg((~a & ~b).cast("double")).alias("double_fault"),
        F.avg((a | b).cast("double")).alias("oracle_accuracy"),
        F.count_if(a & ~b).alias("only_a"),
        F.count_if(~a & b).alias("only_b"),
    )
    flat = pairs.select(F.explode(F.arrays_zip("p_a", "p_b")).alias("z")).agg(correlation("z.p_a", "z.p_b").alias("correlation"))
    return rows.join(F.broadcast(flat))  # one row each


def auroc(rows: DataFrame, by=(), score: str = "score", hit: str = "hit") -> DataFrame:
    """(by, auroc): rank form with ties halved, from counts per distinct score; null if one kind is missing."""
    counts = rows.groupBy(*by, score).agg(F.sum(hit).alias("pos"), F.sum(1 - F.col(hit)).alias("neg"))
    summed = running(counts, by, [F.asc(score)], {"upto": F.col("neg")})
    area = F.col("pos") * (F.col("upto") - F.col("neg") / 2)
    return summed.withColumn("area", area).groupBy(*by).agg(F.try_divide(F.sum("area"), F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"))


def average_precision(rows: DataFrame, by=(), score: str = "score", hit: str = "hit") -> DataFrame:
    """(by, average_precision): sum of recall steps times precision over descending distinct scores; null without a positive."""
    counts = rows.groupBy(*by, score).agg(F.sum(hit).alias("pos"), F.count("*").alias("n"))
    summed = running(counts, by, [F.desc(score)], {"_pos": F.col("pos"), "_n": F.col("n")})
    area = F.col("pos") * F.col("_pos") / F.col("_n")
    return summed.withColumn("area", area).groupBy(*by).agg(F.try_divide(F.sum("area"), F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def macro_auc(preds: DataFrame, by=BY) -> DataFrame:
    """Macro one-vs-rest ROC and PR areas; null if one class has none."""
    keys = [*by, "cls"]
    counts = one_vs_rest(preds, by).groupBy(*keys, "score").agg(F.sum("hit").alias("pos"), F.count("*").alias("n"))
    up = running(counts, keys, [F.desc("score")], {"_pos": F.col("pos"), "_n": F.col("n")}, totals=True)
    neg = F.col("n") - F.col("pos")
    below = (F.col("_n_all") - F.col("_pos_all")) - (F.col("_n") - F.col("_pos"))
    each = up.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * (below + neg / 2)), F.nullif(F.sum("pos") * F.sum(neg), F.lit(0))).alias("auroc"),
        F.try_divide(F.sum(F.col("pos") * F.col("_pos") / F.col("_n")), F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"),
    )
    mean = lambda c: F.when(F.count(c) == F.count("*"), F.avg(c)).alias(f"macro_{c}")
    return each.groupBy(*by).agg(mean("auroc"), mean("average_precision"))


def merged_f1(preds: DataFrame, groups: list[list[int]], by=BY) -> DataFrame:
    """Macro F1 after classes are merged into ``groups``, over rows whose label and prediction both fall into a group."""
    def to(c: str) -> Column:
        out = F.lit(None).cast("int")
        for k, g in enumerate(groups):
            out = F.when(F.col(c).isin(g), k).otherwise(out)
        return out

    rows = preds.withColumn("y", to("y")).withColumn("pred", to("pred")).where("y IS NOT NULL AND pred IS NOT NULL")
    return macro_f1(rows, len(groups), by)


def ks_statistic(rows: DataFrame, value: str, side: str, by=()) -> DataFrame:
    """(by, ks): largest gap between the distributions of ``value`` where ``side`` (boolean) is true and false."""
    counts = rows.groupBy(*by, value).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    summed = running(counts, by, [F.asc(value)], {"_a": F.col("a"), "_b": F.col("b")}, totals=True)
    gap = F.abs(F.col("_a") / F.col("_a_all") - F.col("_b") / F.col("_b_all"))
    return summed.withColumn("gap", gap).groupBy(*by).agg(F.max("gap").alias("ks"))


def ks_test(rows: DataFrame, value: str, side: str, by=()) -> DataFrame:
    """(by, ks, n_a, n_b, p): ``ks_statistic`` with the numbers of values and the p-value of Kolmogorov's limit distribution."""
    sizes = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count_if(F.col(side)).alias("n_a"), F.count_if(~F.col(side)).alias("n_b"))
    ks = ks_statistic(rows.where(F.col(value).isNotNull()), value, side, by)
    both = ks.join(sizes.hint("merge"), list(by)) if by else ks.join(F.broadcast(sizes))
    return both.withColumn("p", kolmogorov_tail(F.col("ks") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))))


def average_rank(rows: DataFrame, value: str, by=(), name: str = "rank") -> DataFrame:
    """Adds the rank of ``value`` with ties averaged, by prefix sums over distinct values."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    summed = running(counts, by, [F.asc(value)], {"_upto": F.col("_n")})
    places = summed.select(*by, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return rows.join(places.hint("merge"), [*by, value])


def spearman(rows: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """(by, n, spearman): correlation of average ranks over rows where both values are present; null if a side is constant."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("_a"), F.col(b).alias("_b"))
    ranks = average_rank(average_rank(both, "_a", by, "_ra"), "_b", by, "_rb")
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), correlation("_ra", "_rb").alias("spearman"))


def spearman_test(rows: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """(by, n, spearman, p): ``spearman`` with the two-sided p-value of Student's distribution with n - 2 degrees of freedom."""
    r, n = F.col("spearman"), F.col("n")
    t = F.when(F.abs(r) >= 1, float("inf")).otherwise(r * F.sqrt((n - 2) / (1 - r * r)))
    return spearman(rows, a, b, by).withColumn("p", t_two_sided(t, n - 2))


def curve_area(points: DataFrame, by, x: str = "x", y: str = "y") -> DataFrame:
    """(by, area): trapezoid area of a curve over its range of x; x must grow strictly within a curve, else the area is null."""
    w = Window.partitionBy(*by).orderBy(x)
    dx = F.col(x) - F.lag(x).over(w)
    rows = points.withColumn("_dx", dx).withColumn("_a", (F.col(y) + F.lag(y).over(w)) / 2 * dx)
    ok = F.coalesce(F.min("_dx") > 0, F.lit(False))
    return rows.groupBy(*by).agg(F.when(ok, F.sum("_a") / (F.max(x) - F.min(x))).alias("area"))
