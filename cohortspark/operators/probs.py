"""Transforms, blends and adaptation of class probabilities. Rows are (model, id, y, p); ``p`` is an array column."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cohortspark.operators import metrics as M
from cohortspark.operators.quantiles import quantiles
from cohortspark.sources.tables import materialize

#: Distinct rows of a group whose priors are estimated in one task.
FEW = 50_000


def held(value: Column | str, f) -> Column:
    """``f`` of a value that is worked out once a row: inside the functions on arrays, an expression is worked out anew wherever it stands, for each element."""
    return F.transform(F.array(value), f)[0]


def total(p: Column | str) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, v: a + v)


def normalised(p: Column | str, floor: float | None = None) -> Column:
    """Shares of the sum; with ``floor``, values are raised to it first. Without it a sum that isn't positive and finite gives null."""
    if floor is not None:
        p = F.transform(p, lambda v: F.greatest(v, F.lit(floor)))
    shares = lambda q, mass: F.when((mass > 0) & (mass < F.lit(float("inf"))), F.transform(q, lambda v: v / mass))
    return held(p, lambda q: held(total(q), lambda mass: shares(q, mass)))


def collapsed(p: str, groups: list[list[int]]) -> Column:
    """Sums of the entries of each group."""
    return F.array(*[sum((F.col(p)[k] for k in g), F.lit(0.0)) for g in groups])


def _width(preds: DataFrame) -> int:
    return preds.agg(F.max(F.size("p"))).first()[0] or 0


def _each(k: int, value) -> list[Column]:
    """An aggregate for each of the ``k`` places of p: ``value`` of the place's column."""
    return [value(F.col("p")[j]).alias(f"_p{j}") for j in range(k)]


def _together(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    return rows.select(*keys, F.array(*[F.col(f"_p{j}") for j in range(k)]).cast("array<double>").alias("p"))


def by_model(preds: DataFrame, models: list[str], keys, k: int) -> DataFrame:
    """(keys, _m0, …, _n): a row per key with the sums of p of each of ``models`` (null without a row) and the number of its rows of each, by one shuffle of the rows as they are."""
    of = lambda m, v: F.when(F.col("model") == m, v)
    sums = [F.sum(of(m, F.col("p")[j])).alias(f"_s{i}_{j}") for i, m in enumerate(models) for j in range(k)]
    rows = preds.where(F.col("model").isin(models)).groupBy(*keys).agg(*sums, *[F.count(of(m, F.lit(1))).alias(f"_n{i}") for i, m in enumerate(models)])
    each = [F.array(*[F.col(f"_s{i}_{j}") for j in range(k)]).cast("array<double>").alias(f"_m{i}") for i in range(len(models))]
    return rows.select(*keys, *each, F.array(*[F.col(f"_n{i}") for i in range(len(models))]).alias("_n"))


def mixed(weights: list[Column], k: int) -> Column:
    """p of a row of ``by_model`` by a weight for each model, null for none."""
    def place(j: int) -> Column:
        terms = [w * F.col(f"_m{i}")[j] for i, w in enumerate(weights)]
        return F.when(F.coalesce(*terms).isNotNull(), sum((F.coalesce(x, F.lit(0.0)) for x in terms), F.lit(0.0)))

    return F.array(*[place(j) for j in range(k)])


def with_weights(rows: DataFrame, weights: DataFrame, models: list[str]) -> DataFrame:
    """Rows of ``by_model`` with ``fusion`` and ``w``, its weights in order of ``models``: one for each fusion that names a model of the row's."""
    wide = weights.groupBy("fusion").agg(F.array(*[F.sum(F.when(F.col("model") == m, F.col("w"))) for m in models]).alias("w"))  # a row per fusion is sent
    some = [F.col("w")[i].isNotNull() & (F.col("_n")[i] > 0) for i in range(len(models))]
    return rows.crossJoin(F.broadcast(wide)).where(reduce(lambda a, b: a | b, some))


def blend(preds: DataFrame, weights: DataFrame, keys=("id", "y"), k: int | None = None) -> DataFrame:
    """(fusion, keys, p): weighted sums over models for all fusions of ``weights`` (fusion, model, w) in one pass; what is shuffled doesn't grow with the fusions.

    ``weights`` is a small table; its checks are ``weight_violations``. ``k`` is the number of classes, looked up if not given.
    """
    k = k or _width(preds)
    models = [r["model"] for r in weights.select("model").where("model IS NOT NULL").distinct().orderBy("model").collect()]  # as many as are blended
    if not models:
        return preds.select(F.lit(None).cast("string").alias("fusion"), *keys, F.col("p").cast("array<double>").alias("p")).where("false")
    rows = with_weights(by_model(preds, models, keys, k), weights, models)
    return rows.select("fusion", *keys, mixed([F.col("w")[i] for i in range(len(models))], k).alias("p"))


def weight_violations(weights: DataFrame, models: list[str]) -> DataFrame:
    """Fusions with a negative weight, a sum other than one, or a model named twice or unknown."""
    known = F.col("model").isin(models)
    return weights.groupBy("fusion").agg(
        F.count_if(F.col("w") < 0).alias("negative"), F.sum("w").alias("total"), F.count_if(~known).alias("unknown"), (F.count("*") - F.count_distinct("model")).alias("repeated")
    ).where("negative > 0 OR abs(total - 1) > 1e-9 OR unknown > 0 OR repeated > 0")


def mean_over(preds: DataFrame, keys=("id", "y"), how: str = "arithmetic", k: int | None = None) -> DataFrame:
    """(keys, p): mean of p over the rows of a key (seeds, perturbations); geometric means are normalised anew."""
    k = k or _width(preds)
    if how == "arithmetic":
        return _together(preds.groupBy(*keys).agg(*_each(k, F.avg)), list(keys), k)
    logs = preds.groupBy(*keys).agg(*_each(k, lambda v: F.exp(F.avg(F.ln(F.greatest(v, F.lit(1e-8)))))))
    return _together(logs, list(keys), k).withColumn("p", normalised("p"))


def weight_grid(spark, models: list[str], units: int) -> DataFrame:
    """(weight_id, model, w): every weighting by multiples of 1 / units that sums to one."""
    grid = spark.range(1).select(F.lit("").alias("weight_id"), F.lit(units).alias("left"))
    for m in models[:-1]:
        n = F.explode(F.sequence(F.lit(0), F.col("left"))).alias("n")
        grid = grid.select("*", n).select("*", F.col("n").alias(f"n_{m}")).withColumn("left", F.col("left") - F.col("n")).withColumn("weight_id", F.concat_ws("|", "weight_id", "n")).drop("n")
    grid = grid.withColumn(f"n_{models[-1]}", F.col("left")).withColumn("weight_id", F.concat_ws("|", "weight_id", "left"))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(f"n_{m}") / units).alias("w")) for m in models])).alias("x")
    return grid.select(F.substring("weight_id", 2, 1000).alias("weight_id"), pairs).select("weight_id", "x.*")


def select_blend(preds: DataFrame, weights: DataFrame, k: int, keys=("id", "y")) -> DataFrame:
    """Scores of every weighting, best first: macro F1 descending, log loss, calibration error, weights. All come from one count of the blended rows."""
    rows, by = M.with_prediction(blend(preds, weights.withColumnRenamed("weight_id", "fusion"), keys, k)), ("fusion",)
    bins, hit = 15, (F.col("y") == F.col("pred")).cast("double")
    loss = -F.ln(F.greatest(M.of_label(), F.lit(M.EPS)))
    at = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    cells = materialize(rows.groupBy("fusion", "y", "pred", at).agg(F.count("*").alias("n"), F.sum(loss).alias("loss"), F.count(loss).alias("losses"), F.sum("conf").alias("conf"), F.sum(hit).alias("hits"), F.count(hit).alias("hit")))
    reliability = cells.groupBy("fusion", "bin").agg(F.sum("n").alias("n"), F.try_divide(F.sum("hits"), F.sum("hit")).alias("accuracy"), (F.sum("conf") / F.sum("n")).alias("confidence"))
    losses = cells.groupBy("fusion").agg(F.try_divide(F.sum("loss"), F.sum("losses")).alias("log_loss"))
    f1 = M.macro(M.per_class(M.confusion(cells, k, by, F.col("n")), by), by).select("fusion", "macro_f1")
    scores = f1.join(losses.hint("merge"), "fusion").join(M.calibration_error(reliability, by).select("fusion", "ece").hint("merge"), "fusion")
    rounded = [F.round(c, 9).alias(c) for c in ("macro_f1", "log_loss", "ece")]
    order = Window.orderBy(F.desc("macro_f1"), "log_loss", "ece", "fusion")  # one row per weighting
    return scores.select("fusion", *rounded).withColumn("place", F.row_number().over(order))


def centred_logs(p: Column | str, eps: float = 1e-12) -> Column:
    logs = F.transform(p, lambda v: F.ln(F.greatest(v, F.lit(eps))))
    return held(logs, lambda z: held(total(z) / F.size(z), lambda middle: F.transform(z, lambda v: v - middle)))


def softmax(z: Column | str) -> Column:
    return held(z, lambda x: held(F.array_max(x), lambda top: normalised(F.transform(x, lambda v: F.exp(v - top)))))


def with_temperature(p: Column | str, t: Column | float) -> Column:
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    return softmax(F.transform(centred_logs(p), lambda v: v / t))


def fit_temperature(preds: DataFrame, by=("model",), rounds: int = 12) -> DataFrame:
    """(by, temperature, nll): least log loss for log temperatures in [-4, 4], by Newton steps on the inverse temperature.

    The loss is convex in it. A round is one aggregate over all rows, of which equal ones are one with a count; the driver holds one number per group.
    """
    each = preds.groupBy(*by, "y", "p").agg(F.count("*").alias("n"))
    base = materialize(each.select(*by, "y", "n", centred_logs("p").alias("z")).select(*by, "n", F.element_at("z", F.col("y") + 1).alias("own"), "z"))
    now = preds.select(*by).distinct().withColumn("b", F.lit(1.0))
    e = held(F.array_max("z"), lambda top: F.transform("z", lambda v: F.exp(F.col("b") * (v - top))))
    moment = lambda k: F.aggregate(F.zip_with("e", "z", lambda w, v: w * F.pow(v, F.lit(k))), F.lit(0.0), lambda a, v: a + v) / total("e")
    for _ in range(rounds):
        rows = base.join(F.broadcast(now), list(by)).withColumn("e", e).withColumns({"m1": moment(1), "m2": moment(2)})
        loss = F.ln(total("e")) + F.col("b") * F.array_max("z") - F.col("b") * F.col("own")
        mean = lambda v: F.sum(F.col("n") * v) / F.sum(F.when(v.isNotNull(), F.col("n")))
        sums = rows.groupBy(*by, "b").agg(mean(F.col("m1") - F.col("own")).alias("g"), mean(F.col("m2") - F.col("m1") * F.col("m1")).alias("h"), mean(loss).alias("nll"))
        step = F.col("b") - F.col("g") / F.greatest("h", F.lit(1e-12))
        bounded = F.greatest(F.least(step, F.col("b") * 3, F.exp(F.lit(4.0))), F.col("b") / 3, F.exp(F.lit(-4.0)))
        found = sums.select(*by, bounded.alias("b"), F.col("b").alias("tried"), "nll")
        told = found.collect()  # one row per group
        done = preds.sparkSession.createDataFrame(told, found.schema)
        if all(abs(r["b"] - r["tried"]) <= 1e-9 * r["tried"] for r in told):
            break
        now = done.select(*by, "b")
    return done.select(*by, (1 / F.col("tried")).alias("temperature"), "nll")


def with_priors(p: Column | str, source: list[float], target: list[float]) -> Column:
    """Probabilities under other class priors."""
    ratio = F.array(*[F.lit(t / max(s, 1e-12)) for s, t in zip(source, target, strict=True)])
    return normalised(F.zip_with(p, ratio, lambda v, r: v * r))


def estimate_priors(preds: DataFrame, source: list[float], tolerance: float = 1e-8, rounds: int = 200) -> tuple[list[float], int, bool]:
    """(priors, rounds, settled) of unlabelled rows by expectation and maximisation; a round is one vector mean."""
    rows = preds.select("p").persist()
    now = list(source)
    try:
        for k in range(1, rounds + 1):
            q = rows.select(with_priors("p", source, now).alias("q"))
            new = q.agg(*[F.avg(F.col("q")[j]).alias(f"c{j}") for j in range(len(source))]).first()
            change = max(abs(a - b) for a, b in zip(new, now, strict=True))
            now = list(new)
            if change < tolerance:
                return now, k, True
        return now, rounds, False
    finally:
        rows.unpersist()


def _settle(source: list[float], own: list[float], by: list[str], tolerance: float, rounds: int):
    """All rounds of ``priors_by`` over the distinct rows of one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p, n, now = np.array(rows["p"].tolist(), np.float64), rows["_n"].to_numpy(np.float64), np.array(source)
        settled, k = False, 0
        while k < rounds and not settled:
            part = p * (now / own)
            mass = part.sum(1)
            sure = (mass > 0) & np.isfinite(mass)
            new = (n[sure, None] * part[sure] / mass[sure, None]).sum(0) / n[sure].sum()
            k, settled, now = k + 1, bool(np.abs(new - now).max() < tolerance), new
        return pd.DataFrame({**{b: rows[b].iloc[:1] for b in by}, "priors": pd.Series([now.tolist()], index=rows.index[:1]), "rounds": k, "settled": settled})

    return run


def priors_by(preds: DataFrame, source: list[float], by=("model",), tolerance: float = 1e-8, rounds: int = 200) -> DataFrame:
    """(by, priors, rounds, settled): ``estimate_priors`` of every group side by side.

    Equal rows are one with a count. A group of at most ``FEW`` distinct rows goes through all its rounds in one task; of the others, a round is one
    pass over the groups that still move, for which the driver holds a few numbers per group. Groups whose key is null and rows without p take no part.
    """
    spark, by = preds.sparkSession, list(by)
    base = materialize(preds.dropna(subset=[*by, "p"]).groupBy(*by, "p").agg(F.count("*").alias("_n")))
    own = [max(x, 1e-12) for x in source]
    typed = ", ".join(f"`{b}` {base.schema[b].dataType.simpleString()}" for b in by) + ", priors array<double>, rounds int, settled boolean"
    sizes = materialize(base.groupBy(*by).agg((F.count("*") <= FEW).alias("_few")))
    few = base.join(sizes.where("_few").select(*by).hint("merge"), by)
    told = materialize(few.groupBy(*by).applyInPandas(_settle(source, own, by, tolerance, rounds), typed))
    moving, done = [(*r, list(source)) for r in sizes.where("NOT _few").select(*by).collect()], []
    if not moving:
        return told
    base = materialize(base.join(sizes.where("NOT _few").select(*by).hint("merge"), by))
    part = [F.col("p")[j] * (F.col("_now")[j] / x) for j, x in enumerate(own)]
    mass = sum(part, F.lit(0.0))
    n = F.when((mass > 0) & (mass < F.lit(float("inf"))), F.col("_n"))
    mean = lambda j: F.sum(n * (part[j] / F.when(n.isNotNull(), mass))) / F.sum(n)
    names = [*by, "_now"]
    kinds = base.select(*by, F.lit(None).cast("array<double>").alias("_now")).schema
    for k in range(1, rounds + 1):
        if not moving:
            break
        local = pa.table({n: [m[i] for m in moving] for i, n in enumerate(names)}, to_arrow_schema(kinds))  # rows of the plan itself, no job
        now = F.broadcast(spark.createDataFrame(local))
        sums = base.join(now, by).groupBy(*by, "_now").agg(*[mean(j).alias(f"_c{j}") for j in range(len(source))])
        still = []
        for r in sums.collect():
            new = [r[f"_c{j}"] for j in range(len(source))]
            row = (*[r[b] for b in by], new)
            settled = max(abs(a - b) for a, b in zip(new, r["_now"], strict=True)) < tolerance
            if settled or k == rounds:
                done.append((*row, k, settled))
            else:
                still.append(row)
        moving = still
    return told.unionByName(spark.createDataFrame(done, typed))


def search_offsets(preds: DataFrame, k: int, span: float = 2.5, points: int = 101, by=()) -> DataFrame:
    """(by, o1, o2, macro_f1): log offsets of classes 1 and 2 (the others stay) with the best macro F1 of the whole grid of ``points`` x ``points`` on [-span, span]; ties to the least norm.

    A row's classes win where two of its borders are passed: class 1 from tick i1 on and while i - j >= d, class 2 from tick i2 on and while
    i - j < d, and below i1 and i2 the best of the other classes. So rows are counted by their borders (at most some 20,000 cells a class,
    however many rows), and running sums of the counts score all points at once.
    """
    last, step, by = points - 1, 2 * span / (points - 1), list(by)
    z = F.transform("p", lambda v: F.ln(F.greatest(v, F.lit(1e-12))))
    rest = F.filter("z", lambda v, i: (i != 1) & (i != 2))
    rows = preds.where(F.col("p").isNotNull() & F.col("y").between(0, k - 1)).select(*by, "y", z.alias("z")).select(
        *by, "y", F.col("z")[1].alias("z1"), F.coalesce(F.get("z", F.lit(2)), F.lit(-1e6)).alias("z2"), F.array_max(rest).alias("zo"), (F.array_position(rest, F.array_max(rest)) - 1).alias("m")
    )
    ticks = lambda gap: F.round(gap / step, 9)
    start = lambda t: F.when(F.col("m") == 0, F.floor(t) + 1).otherwise(F.ceil(t))  # noqa: E731  # of equal values the first class wins
    held = lambda c, low, high: F.greatest(F.least(c, F.lit(high)), F.lit(low)).cast("int")
    rows = rows.select(
        *by, "y", F.when(F.col("m") > 0, F.col("m") + 2).otherwise(0).cast("int").alias("m"), held(start(ticks(F.col("zo") - F.col("z1") + span)), 0, points).alias("i1"),
        held(start(ticks(F.col("zo") - F.col("z2") + span)), 0, points).alias("i2"), held(F.ceil(ticks(F.col("z2") - F.col("z1"))), -last, points).alias("d"),
    ).groupBy(*by, "y", "m", "i1", "i2", "d").agg(F.count("*").alias("n"))
    # A class is predicted at a point iff u <= U and v <= V there; U runs from 0 to last.
    event = lambda c, u, v: F.struct(c.alias("c"), u.alias("u"), v.alias("v"))
    i1, i2, d = F.col("i1"), F.col("i2"), F.col("d")
    events = rows.select(*by, "y", "n", F.explode(F.array(event(F.col("m"), points - i1, points - i2), event(F.lit(1), i1, d), event(F.lit(2), i2, -d))).alias("e")).select(*by, "y", "n", "e.*")
    cells = events.where(F.col("u") <= last).groupBy(*by, "c", "u", "v").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("c"), F.col("n")).otherwise(0)).alias("hits"))
    spread = cells.select(*by, "c", F.explode(F.sequence("u", F.lit(last))).alias("u"), "v", "n", "hits").groupBy(*by, "c", "u", "v").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    none, i, j = F.lit(None).cast("int"), F.col("i"), F.col("j")
    tick = F.sequence(F.lit(0), F.lit(last))
    each = preds.select(*by).distinct() if by else preds.sparkSession.range(1).select()
    asked = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("c")).select("*", F.explode(tick).alias("i")).select("*", F.explode(tick).alias("j"))
    asked = asked.select(*by, "c", F.when(F.col("c") == 1, i).when(F.col("c") == 2, j).otherwise(last - i).alias("u"), F.when(F.col("c") == 1, i - j).when(F.col("c") == 2, j - i - 1).otherwise(last - j).alias("v"), F.lit(0).alias("n"), F.lit(0).alias("hits"), "i", "j")
    up = Window.partitionBy(*by, "c", "u").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # bounded by the grid
    sums = spread.withColumns({"i": none, "j": none}).unionByName(asked).select(*by, "c", "i", "j", F.sum("n").over(up).alias("predicted"), F.sum("hits").over(up).alias("tp")).where("i IS NOT NULL")
    support = rows.groupBy(*by, F.col("y").alias("c")).agg(F.sum("n").alias("support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.coalesce("support", F.lit(0)) + F.col("predicted")), F.lit(0.0))
    scores = sums.join(support.hint("merge"), [*by, "c"], "left").groupBy(*by, "i", "j").agg((F.sum(f1) / k).alias("macro_f1"))
    norm = (2 * i - last) * (2 * i - last) + (2 * j - last) * (2 * j - last)
    place = F.struct(-F.round("macro_f1", 12), norm, i, j)
    best = scores.groupBy(*by).agg(F.min_by(F.struct("i", "j", "macro_f1"), place).alias("b")).select(*by, "b.*")
    return best.select(*by, F.round(i * step - span, 9).alias("o1"), F.round(j * step - span, 9).alias("o2"), "macro_f1")


def factorised(seated: Column | str, moving: Column | str) -> Column:
    """[seated, still upright, moving upright] from P(seated) and P(moving | upright)."""
    s, m = (F.col(x) if isinstance(x, str) else x for x in (seated, moving))
    return F.array(s, (1 - s) * (1 - m), (1 - s) * m)


def jensen_shannon(p: str, q: str) -> Column:
    mid = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    kl = lambda x: F.aggregate(F.zip_with(x, mid, lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v)
    return (kl(p) + kl(q)) / 2


def stack_features(wide: DataFrame, columns: list[str], geometry: str | None = None, reliability: bool = True, eps: float = 1e-6) -> DataFrame:
    """Adds ``features``: clipped logs of every model's probabilities, geometry, and reliability (maximum, entropy, margin, pairwise divergence)."""
    parts = [F.transform(c, lambda v: F.ln(F.least(F.greatest(v, F.lit(eps)), F.lit(1 - eps)))) for c in columns]
    if geometry:
        parts.append(F.col(geometry))
    if reliability:
        for c in columns:
            top = F.sort_array(c, asc=False)
            entropy = F.aggregate(c, F.lit(0.0), lambda a, v: a - F.when(v > 0, v * F.ln(v)).otherwise(0.0))
            parts.append(F.array(F.array_max(c), entropy, top[0] - top[1]))
        parts += [F.array(jensen_shannon(a, b)) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return wide.withColumn("features", F.concat(*parts))


def probability_violations(preds: DataFrame, tolerance: float = 1e-6, key: str = "id") -> DataFrame:
    """(key, reason) of rows whose probabilities are missing, not finite, out of [0, 1] or don't sum to one, or whose label is no class."""
    bad = F.exists("p", lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1))
    reason = (
        F.when(F.col("p").isNull() | (F.size("p") == 0), "missing").when(bad, "range").when(F.abs(total("p") - 1) > tolerance, "sum")
        .when(F.col("y").isNull() | (F.col("y") < 0) | (F.col("y") >= F.size("p")), "label")
    )
    return preds.select(key, reason.alias("reason")).where("reason IS NOT NULL")


def per_image(preds: DataFrame, image: str, k: int | None = None) -> DataFrame:
    """(image, y, p): mean probabilities of an image's rows, normalised; only images with a single label."""
    k = k or _width(preds)
    rows = preds.groupBy(image).agg(F.min("y").alias("y"), F.max("y").alias("_y"), *_each(k, F.avg)).where("y = _y")
    return _together(rows, [image, "y"], k).withColumn("p", normalised("p"))


def drift(clean: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Agreement of classes, mean and largest absolute gap of probabilities, median margin where the class changed and where not."""
    both = clean.select(key, F.col("pred").alias("a"), F.col("p").alias("pa")).join(changed.select(key, F.col("pred").alias("b"), F.col("p").alias("pb")).hint("merge"), key)
    gaps = F.zip_with("pa", "pb", lambda x, y: F.abs(x - y))
    top = F.sort_array("pa", asc=False)
    rows = both.select("a", "b", (total(gaps) / F.size(gaps)).alias("g"), F.array_max(gaps).alias("m"), (top[0] - top[1]).alias("margin"))
    rows = materialize(rows.withColumn("same", F.col("a") == F.col("b")))
    whole = rows.agg(F.count("*").alias("n"), F.avg(F.col("same").cast("double")).alias("agreement"), F.avg("g").alias("mean_gap"), F.max("m").alias("max_gap"))
    middle = quantiles(rows, "margin", [0.5], ["same"]).select("same", F.col("q")[0].alias("q"))
    return whole.join(F.broadcast(middle.agg(F.max(F.when(~F.col("same"), F.col("q"))).alias("margin_changed"), F.max(F.when(F.col("same"), F.col("q"))).alias("margin_stable"))))
