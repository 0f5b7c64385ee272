"""Tables of a study: strata, ensembles, curves, attribution maps, replayed evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions.special import array_spearman
from cohortspark.operators import metrics as M
from cohortspark.operators.quantiles import quantiles
from cohortspark.sources.tables import materialize


def with_strata(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per row and stratum (stratum, value), and one for 'overall': metrics grouped by both give the whole table in one pass."""
    tags = [F.struct(F.lit("overall").alias("stratum"), F.lit("all").alias("value"))] + [F.struct(F.lit(c).alias("stratum"), F.col(c).cast("string").alias("value")) for c in columns]
    return rows.withColumn("_t", F.explode(F.array(*tags))).withColumns({"stratum": F.col("_t.stratum"), "value": F.col("_t.value")}).drop("_t")


def stratum_metrics(preds: DataFrame, columns: list[str], k: int, group: str = "grp", by=("model",)) -> DataFrame:
    """(stratum, value, by, n, groups, accuracy, macro_f1)."""
    rows, keys = with_strata(preds, columns), ("stratum", "value", *by)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(group).alias("groups"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))
    return counts.join(M.macro_f1(rows, k, keys).hint("merge"), list(keys))


def wide_predictions(preds: DataFrame) -> DataFrame:
    """(id, y, votes): the predictions of all models of an id, in order of the models' names."""
    return preds.groupBy("id", "y").agg(F.array_sort(F.collect_list(F.struct("model", "pred"))).alias("v")).select("id", "y", F.col("v.pred").alias("votes"))


def ensemble_structure(preds: DataFrame, by: list[Column] = ()) -> DataFrame:
    """(by, n, oracle, disagreement, unanimous_errors) of the models together."""
    w = wide_predictions(preds)
    right, differ = F.exists("votes", lambda v: v == F.col("y")), F.size(F.array_distinct("votes")) > 1
    return w.groupBy(*by).agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("oracle"), F.avg(differ.cast("double")).alias("disagreement"), F.count_if(~differ & ~right).alias("unanimous_errors"))


def error_families(preds: DataFrame, named: list[tuple[int, int]], by=("model",)) -> DataFrame:
    """(by, family, errors, share): errors by unordered pair of classes; pairs that aren't named count as other."""
    pair = F.concat_ws("-", F.least("y", "pred"), F.greatest("y", "pred"))
    family = F.when(pair.isin([f"{min(a, b)}-{max(a, b)}" for a, b in named]), pair).otherwise("other")
    out = preds.where("y <> pred").groupBy(*by, family.alias("family")).agg(F.count("*").alias("errors"))
    return out.withColumn("share", F.col("errors") / F.sum("errors").over(Window.partitionBy(*by)))


def unanimity(preds: DataFrame, main: str) -> DataFrame:
    """Error rate of ``main`` where all models agree and where not, and the AUROC of disagreement for its errors."""
    w = wide_predictions(preds).join(preds.where(F.col("model") == main).select("id", "pred").hint("merge"), "id")
    rows = w.select((F.col("y") != F.col("pred")).cast("int").alias("hit"), (F.size(F.array_distinct("votes")) > 1).cast("int").alias("score"))
    rates = rows.agg(F.count("*").alias("n"), F.avg(F.when(F.col("score") == 0, F.col("hit"))).alias("error_unanimous"), F.avg(F.when(F.col("score") == 1, F.col("hit"))).alias("error_differing"))
    return rates.join(F.broadcast(M.auroc(rows)))


def adjacent_errors(preds: DataFrame, by=("model",)) -> DataFrame:
    """(by, errors, adjacent, share) of errors by one step."""
    return preds.where("y <> pred").groupBy(*by).agg(F.count("*").alias("errors"), F.count_if(F.abs(F.col("y") - F.col("pred")) == 1).alias("adjacent")).withColumn("share", F.col("adjacent") / F.col("errors"))


def leave_one_out(preds: DataFrame, models: list[str], k: int) -> DataFrame:
    """(omitted, accuracy, macro_f1, agreement): equal blends without one model, and their agreement with the blend of all ('none')."""
    from cohortspark.operators.probs import by_model, mixed, with_weights

    table = [("none", m, 1 / len(models)) for m in models] + [(o, m, 1 / (len(models) - 1)) for o in models for m in models if m != o]
    weights = preds.sparkSession.createDataFrame(table, "fusion string, model string, w double")
    best = lambda w: M.with_prediction(rows.select("*", F.transform(mixed(w, k), lambda v: F.round(v, 12)).alias("p"))).drop("p", "conf")
    rows = by_model(preds, models, ("id", "y"), k)
    rows = best([F.lit(1 / len(models))] * len(models)).withColumnRenamed("pred", "base")  # the blend of all stays with its row
    rows = with_weights(rows, weights, models)
    rows = best([F.col("w")[i] for i in range(len(models))]).withColumnRenamed("fusion", "omitted")
    wrong, by = (F.col("y") != F.col("pred")).cast("int"), ("omitted",)
    cells = rows.groupBy("omitted", "y", "pred").agg(F.count("*").alias("n"), F.sum(wrong).alias("wrong"), F.count(wrong).alias("told"), F.sum((F.col("pred") == F.col("base")).cast("int")).alias("same"), F.count(F.col("pred") == F.col("base")).alias("both"))
    cells = materialize(cells)
    out = cells.groupBy("omitted").agg((1 - F.try_divide(F.sum("wrong"), F.sum("told"))).alias("accuracy"), F.try_divide(F.sum("same"), F.sum("both")).alias("agreement"))
    f1 = M.macro(M.per_class(M.confusion(cells, k, by, F.col("n")), by), by)
    return out.join(f1.select("omitted", "macro_f1").hint("merge"), "omitted").select("omitted", "accuracy", "macro_f1", "agreement")


def _with(out: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """Left join of rows per group, nulls in keys equal."""
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_r_{b}"))
    right = more.select(*[F.col(b).alias(f"_r_{b}") for b in by], *[c for c in more.columns if c not in by])
    return out.join(right.hint("merge"), same, "left").drop(*[f"_r_{b}" for b in by])


def domain_shift(source: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """Medians of both, their ratio, the target's share at or below the source's first quartile, and the KS statistic."""
    both = source.select(F.col(value).alias("v"), F.lit(True).alias("s")).unionByName(target.select(F.col(value).alias("v"), F.lit(False).alias("s")))
    q = materialize(quantiles(source, value, [0.25, 0.5]))
    t = quantiles(target, value, [0.5]).select(F.col("q")[0].alias("target_median"))
    below = target.join(F.broadcast(q)).agg(F.avg((F.col(value) <= F.col("q")[0]).cast("double")).alias("below_q1"))
    return q.select(F.col("q")[1].alias("source_median")).join(F.broadcast(t)).withColumn("ratio", F.col("target_median") / F.col("source_median")).join(F.broadcast(below)).join(F.broadcast(M.ks_statistic(both, "v", "s")))


def shares(rows: DataFrame, tests: dict[str, tuple[Column, Column]], by=()) -> DataFrame:
    """(by, name, numerator, denominator, share): counts of a condition among the rows of another; share null without any."""
    out = rows.groupBy(*by).agg(*[F.struct(F.count_if(a & b).alias("numerator"), F.count_if(b).alias("denominator")).alias(n) for n, (a, b) in tests.items()])
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n)["numerator"].alias("numerator"), F.col(n)["denominator"].alias("denominator")) for n in tests])).alias("x")
    return out.select(*by, long).select(*by, "x.*").withColumn("share", F.try_divide("numerator", "denominator"))


def mixed_images(preds: DataFrame, image: str, k: int, by=("model",)) -> DataFrame:
    """(by, rows, images, accuracy, macro_f1, varying) over images with several labels; varying counts those whose predictions differ."""
    mixed = preds.groupBy(*by, image).agg(F.count_distinct("y").alias("_l"), F.count_distinct("pred").alias("_p")).where("_l > 1")
    rows = preds.join(mixed.select(*by, image).hint("merge"), [*by, image], "left_semi")
    counts = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))
    images = mixed.groupBy(*by).agg(F.count("*").alias("images"), F.count_if(F.col("_p") > 1).alias("varying"))
    return counts.join(images.hint("merge"), list(by)).join(M.macro_f1(rows, k, by).hint("merge"), list(by))


def scale_trend(runs: DataFrame, size: str, score: str) -> DataFrame:
    """(sizes, slope, intercept, r2) of the mean score per size on log2 of the size."""
    means = runs.groupBy(size).agg(F.avg(score).alias("y"), F.count("*").alias("n"))
    x = F.log2(size)
    return means.agg(F.count("*").alias("sizes"), F.regr_slope("y", x).alias("slope"), F.regr_intercept("y", x).alias("intercept"), F.regr_r2("y", x).alias("r2"))


def scale_sizes(runs: DataFrame, size: str, score: str, seed: str = "seed", digest: str | None = None) -> DataFrame:
    """(size, first, n, digests, scores, identical) per size: the score of the least seed, how many runs, subsets and scores there are, and whether all repeats are one."""
    subset = F.col(digest) if digest else F.lit("")
    out = runs.groupBy(F.col(size).alias("size")).agg(
        F.min_by(score, F.struct(seed, score)).alias("first"), F.count("*").alias("n"), F.count_distinct(subset).alias("digests"), F.count_distinct(F.col(score)).alias("scores")
    )
    return out.withColumn("identical", (F.col("digests") == 1) & (F.col("scores") == 1))


def repeated_runs(runs: DataFrame, by: list[str], score: str, seed: str = "seed") -> DataFrame:
    """(by, runs, seeds, mean, sd, q05, median, q95)."""
    q = F.percentile(score, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = runs.groupBy(*by).agg(F.count("*").alias("runs"), F.count_distinct(seed).alias("seeds"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), q.alias("q"))
    return out.select(*by, "runs", "seeds", "mean", "sd", *[F.col("q")[k].alias(n) for k, n in enumerate(("q05", "median", "q95"))])


def manifest_summary(rows: DataFrame, value: str, digest: str, by: list[str]) -> DataFrame:
    """(by, n, digests, repeated, mean, p05, median, p95)."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(digest).alias("digests"), F.avg(value).alias("mean"))
    out = _with(out, quantiles(rows, value, [0.05, 0.5, 0.95], by), by)
    return out.select(*by, "n", "digests", (F.col("n") - F.col("digests")).alias("repeated"), "mean", *[F.col("q")[k].alias(n) for k, n in enumerate(("p05", "median", "p95"))])


def top_rows(rows: DataFrame, by: list[str], keys: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where(F.col("_at") <= n).drop("_at")


def map_agreement(maps: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(key, spearman) of two maps per row; constant maps: 1 if both are, else 0."""
    rows = maps.select(key, F.explode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("z")).select(key, "z.a", "z.b")
    ranked = M.average_rank(M.average_rank(rows, "a", (key,), "_ra"), "b", (key,), "_rb")
    flat_a, flat_b = F.min("a") == F.max("a"), F.min("b") == F.max("b")
    return ranked.groupBy(key).agg(F.when(flat_a & flat_b, 1.0).when(flat_a | flat_b, 0.0).otherwise(M.correlation("_ra", "_rb")).alias("spearman"))


def faithfulness(points: DataFrame, key: str) -> DataFrame:
    """(key, deletion, insertion, random, gap) from curve rows (key, metric, x, y): areas per curve, and random minus deletion."""
    areas = M.curve_area(points, (key, "metric"))
    out = areas.groupBy(key).pivot("metric", ["deletion", "insertion", "random"]).agg(F.first("area"))
    return out.withColumn("gap", F.col("random") - F.col("deletion"))


def road(points: DataFrame, key: str) -> DataFrame:
    """(key, most, least, random, gap, combined) from curve rows (key, metric, x, y) of removal in falling, rising and random order of
    attribution: areas per curve, least minus most, and half that difference averaged over the points that both curves have."""
    names = ["most", "least", "random"]
    out = M.curve_area(points, (key, "metric")).groupBy(key).pivot("metric", names).agg(F.first("area"))
    at = points.groupBy(key, "x").pivot("metric", names[:2]).agg(F.first("y"))
    combined = at.groupBy(key).agg(F.avg((F.col("least") - F.col("most")) / 2).alias("combined"))
    return out.withColumn("gap", F.col("least") - F.col("most")).join(combined.hint("merge"), key).select(key, *names, "gap", "combined")


def subset_faithfulness(subsets: DataFrame, key: str, original: str = "original") -> DataFrame:
    """(key, subsets, spearman) of (key, original, mass, probability) rows, one for each removed subset: rank correlation of the subset's
    attribution mass and of the fall of the probability; constant ones: 1 if both are, else 0. A key's subsets are a fixed plan, some tens."""
    pairs = subsets.groupBy(key).agg(F.collect_list(F.struct("mass", (F.col(original) - F.col("probability")).alias("drop"))).alias("_p"))
    return pairs.select(key, F.size("_p").alias("subsets"), array_spearman(F.col("_p.mass"), F.col("_p.drop")).alias("spearman"))


def localisation(maps: DataFrame, values: str, width: int, box: tuple[str, str, str, str], key: str) -> DataFrame:
    """(key, mass, area, lift, pointing): share of the map's positive mass in the box, the box's share of cells, their ratio, and whether the first largest cell lies in it."""
    x0, y0, x1, y1 = box
    rows = maps.select(key, x0, y0, x1, y1, F.posexplode(values).alias("at", "v"))
    col, row = F.col("at") % width, F.floor(F.col("at") / width)
    inside = (col >= F.col(x0)) & (col < F.col(x1)) & (row >= F.col(y0)) & (row < F.col(y1))
    out = rows.withColumn("_in", inside).withColumn("v", F.greatest("v", F.lit(0))).groupBy(key).agg(
        F.try_divide(F.sum(F.when(F.col("_in"), F.col("v")).otherwise(0)), F.sum("v")).alias("mass"), F.avg(F.col("_in").cast("double")).alias("area"), F.max_by("_in", F.struct("v", -F.col("at"))).alias("pointing")
    )
    return out.withColumn("lift", F.try_divide("mass", "area"))


def method_table(rows: DataFrame, by: list[str], eligible: str, score: str) -> DataFrame:
    """(by, eligible, n, mean, sd, place): methods ranked by mean, then by spread and name; ineligible ones have no place."""
    out = rows.groupBy(*by, eligible).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"))
    place = F.row_number().over(Window.partitionBy(by[0], eligible).orderBy(F.desc(F.round("mean", 9)), F.round("sd", 9), *by))
    return out.withColumn("place", F.when(F.col(eligible), place))


def medians(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count("*").alias("n"))
    for v in values:
        out = _with(out, quantiles(rows, v, [0.5], by), by).withColumn("q", F.col("q")[0]).withColumnRenamed("q", f"median_{v}")
    return out


# Replay of stored evidence


def long_metrics(wide: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, value) of the numeric columns of a wide table of metrics."""
    names = [c for c, t in wide.dtypes if c not in by and t in ("double", "int", "bigint")]
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")).select(*by, "x.*")


def replay(actual: DataFrame, expected: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(keys, actual, expected, problem): figures that differ by more than the tolerance, or stand on one side only."""
    a, b = actual.select(*keys, F.col("value").alias("actual"), F.lit(1).alias("_a")), expected.select(*keys, F.col("value").alias("expected"), F.lit(1).alias("_b"))
    both = a.join(b.hint("merge"), keys, "full_outer")
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(~(F.col("actual").eqNullSafe(F.col("expected"))) & ~F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.lit(False)), "changed")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select(*keys, "actual", "expected", "problem")


def probability_gap(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(rows, max_gap, mean_gap, same_class, within): stored against recomputed probabilities."""
    both = a.select(*keys, F.col("p").alias("pa")).join(b.select(*keys, F.col("p").alias("pb")).hint("merge"), keys)
    gap = F.zip_with("pa", "pb", lambda x, y: F.abs(x - y))
    first = lambda c: F.array_position(c, F.array_max(c))
    rows = both.select(F.array_max(gap).alias("m"), (F.aggregate(gap, F.lit(0.0), lambda s, v: s + v) / F.size(gap)).alias("g"), (first("pa") == first("pb")).alias("s"))
    return rows.agg(F.count("*").alias("rows"), F.max("m").alias("max_gap"), F.avg("g").alias("mean_gap"), F.avg(F.col("s").cast("double")).alias("same_class"), (F.max("m") <= tolerance).alias("within"))


def bindings(expected: DataFrame, actual: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, problem): files that are missing, changed or not declared."""
    both = expected.select(key, F.col(digest).alias("_e")).join(actual.select(key, F.col(digest).alias("_a")).hint("merge"), key, "full_outer")
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_a") != F.col("_e"), "changed")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def rescored(matrices: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, accuracy, macro_f1, weighted_f1) from exported confusion counts (by, y, pred, n) alone; negative counts are an error."""
    sure = matrices.withColumn("n", F.when(F.col("n") >= 0, F.col("n")).otherwise(F.raise_error(F.lit("negative count")).cast("bigint")))
    acc = sure.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return acc.join(M.macro(M.per_class(sure, by), by).select(*by, "macro_f1", "weighted_f1").hint("merge"), by)


def fit_ledger(declared: DataFrame, runs: DataFrame, keys: list[str], config: list[str]) -> DataFrame:
    """(keys, runs, runtime, problem): each declared fit with the number of its runs, their time, and what is wrong: missing, repeated, undeclared, or the differing settings."""
    have = runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum("runtime").alias("runtime"), *[F.max(c).alias(f"_{c}") for c in config])
    both = declared.withColumn("_d", F.lit(1)).join(have.hint("merge"), keys, "full_outer")
    wrong = F.array_join(F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in config]), lambda x: x.isNotNull()), ",")
    problem = F.when(F.col("runs").isNull(), "missing").when(F.col("_d").isNull(), "undeclared").when(F.col("runs") > 1, "repeated").otherwise(wrong)
    return both.select(*keys, F.coalesce("runs", F.lit(0)).alias("runs"), "runtime", problem.alias("problem"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
