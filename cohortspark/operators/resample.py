"""Bootstrap and randomization of prediction comparisons. Random numbers are hashes of (seed, draw, key), so results don't
depend on partitioning and SQL can repeat them.

Rows are first reduced to counts per (group, label, prediction a, prediction b); only these meet the draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.draws import BLOCK, POISSON, coin, comparisons_of, hashed, md5_numbers, poisson, ranked_areas, vector_sums

def uniform(seed: object, *keys: str) -> Column:
    """A 32-bit number for each seed and keys (the first of them usually the draw)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def poisson_weight(u: Column) -> Column:
    return sum((F.when(u >= t, 1).otherwise(0) for t in POISSON), F.lit(0))


def cells(pairs: DataFrame, group: str | None = "grp", by=()) -> DataFrame:
    keys = [*by, *([group] if group else []), "y", "pred_a", "pred_b"]
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"))


def with_draws(rows: DataFrame, draws: int, first: int = 0) -> DataFrame:
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(first + draws - 1))))


def _exploded(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, draw, n) of arrays over draws: as many rows as there are cells and draws."""
    return sums.select(*keys, "block", F.posexplode("v").alias("_at", "n")).select(*keys, (F.col("block") * BLOCK + F.col("_at") - 1).cast("int").alias("draw"), "n")


def cluster_draws(pairs: DataFrame, draws: int, seed: object, group: str = "grp", by=()) -> DataFrame:
    """(by, draw, y, pred_a, pred_b, n): counts with each group weighted by Poisson(1). Draw -1 is the table as it is."""
    keys = [*by, "y", "pred_a", "pred_b"]
    return _exploded(vector_sums(cells(pairs, group, by), group, keys, draws, hashed(md5_numbers, poisson, seed)), keys)


def _scores(drawn: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(by, cls, f1_a, f1_b, support) per declared class."""
    side = lambda s: drawn.select(*by, F.lit(s).alias("side"), "y", F.col(f"pred_{s}").alias("pred"), "n")
    rows = side("a").unionByName(side("b"))
    right = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0)
    parts = rows.select(*by, "side", F.col("y").alias("cls"), F.col("n").alias("s"), zero.alias("p"), right.alias("t")).unionByName(
        rows.select(*by, "side", F.col("pred").alias("cls"), zero.alias("s"), F.col("n").alias("p"), zero.alias("t"))
    )
    sums = parts.groupBy(*by, "cls").agg(*[F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0)).alias(f"{c}_{s}") for s in "ab" for c in "spt"])
    f1 = lambda s: F.coalesce(F.try_divide(2 * F.col(f"t_{s}"), F.col(f"s_{s}") + F.col(f"p_{s}")), F.lit(0.0)).alias(f"f1_{s}")
    return sums.select(*by, "cls", f1("a"), f1("b"), F.col("s_a").alias("support"))


def deltas(drawn: DataFrame, k: int, by=()) -> DataFrame:
    """(by, draw, macro_a, macro_b, delta, accuracy_a, accuracy_b, classes): classes counts those with labels in the draw."""
    keys = [*by, "draw"]
    macro = _scores(drawn, k, keys).groupBy(*keys).agg((F.sum("f1_a") / k).alias("macro_a"), (F.sum("f1_b") / k).alias("macro_b"), F.count_if(F.col("support") > 0).alias("classes"))
    hit = lambda s: (F.sum(F.when(F.col("y") == F.col(f"pred_{s}"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0))).alias(f"accuracy_{s}")
    return macro.join(drawn.groupBy(*keys).agg(hit("a"), hit("b")).hint("merge"), keys).withColumn("delta", F.col("macro_b") - F.col("macro_a"))


def class_deltas(drawn: DataFrame, k: int, by=()) -> DataFrame:
    """(by, draw, cls, delta) of per-class F1."""
    return _scores(drawn, k, [*by, "draw"]).select(*by, "draw", "cls", (F.col("f1_b") - F.col("f1_a")).alias("delta"))


def interval(drawn: DataFrame, value: str = "delta", by=()) -> DataFrame:
    """(by, point, low, high, p_positive, p_two_sided, draws) from rows (by, draw, value); the point is draw -1."""
    v, real = F.col(value), F.col("draw") >= 0
    out = drawn.groupBy(*by).agg(
        F.max(F.when(~real, v)).alias("point"), F.percentile(F.when(real, v), F.array(F.lit(0.025), F.lit(0.975))).alias("_q"), F.avg(F.when(real, (v > 0).cast("double"))).alias("p_positive"),
        F.count_if(real & (v <= 0)).alias("_low"), F.count_if(real & (v >= 0)).alias("_high"), F.count_if(real).alias("draws"),
    )
    p = F.least(F.lit(1.0), 2 * F.least(F.col("_low") + 1, F.col("_high") + 1) / (F.col("draws") + 1))
    return out.select(*by, "point", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "p_positive", p.alias("p_two_sided"), "draws")


def complete_draws(drawn: DataFrame, k: int, wanted: int, by=()) -> DataFrame:
    """Draws in which every class has labels, the first ``wanted`` of them, with ``rejected``: how many draws lacked one."""
    from pyspark.sql import Window

    real = drawn.where("draw >= 0")
    rejected = real.groupBy(*by).agg(F.count_if(F.col("classes") < k).alias("rejected"))
    good = real.where(F.col("classes") == k).withColumn("_at", F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("draw"))).where(F.col("_at") <= wanted).drop("_at")
    rows = good.unionByName(drawn.where("draw < 0"))
    return rows.join(rejected.hint("merge"), list(by)) if by else rows.join(F.broadcast(rejected))


def randomization(pairs: DataFrame, k: int, draws: int, seed: object, group: str = "grp", by=()) -> DataFrame:
    """(by, observed, extreme, p): two-sided test of the macro F1 difference; in each draw a coin per group swaps the models' predictions.

    Only groups where the models differ need a coin; the rest enters every draw as it is.
    """
    keys = [*by, "y", "pred_a", "pred_b"]
    base = cells(pairs, group, by)
    tossed = hashed(md5_numbers, coin, seed)
    sums = vector_sums(base.where("pred_a <> pred_b"), group, keys, draws, lambda d, k: np.where(d >= 0, tossed(d, k), 0.0))
    swapped = _exploded(sums, keys)
    back = swapped.select(*by, "draw", "y", F.col("pred_b").alias("pred_a"), F.col("pred_a").alias("pred_b"), "n")
    whole = with_draws(base.groupBy(*keys).agg(F.sum("n").alias("n")), draws + 1, -1)
    rows = whole.unionByName(swapped.withColumn("n", -F.col("n"))).unionByName(back)
    stats = deltas(rows.groupBy(*by, "draw", "y", "pred_a", "pred_b").agg(F.sum("n").alias("n")), k, by).select(*by, "draw", "delta")
    seen = stats.where("draw = -1").select(*by, F.col("delta").alias("observed"))
    real = stats.where("draw >= 0")
    both = real.join(F.broadcast(seen), list(by)) if by else real.join(F.broadcast(seen))
    return both.groupBy(*by, "observed").agg(F.count_if(F.abs("delta") >= F.abs("observed") - 1e-12).alias("extreme"), F.count("*").alias("_n")).select(
        *by, "observed", "extreme", ((F.col("extreme") + 1) / (F.col("_n") + 1)).alias("p")
    )


def stratified_bootstrap(pairs: DataFrame, k: int, draws: int, seed: int) -> DataFrame:
    """(draw, macro_a, macro_b, delta): rows of a class are drawn anew among themselves (multinomial over its cells, K * K at most).

    The K ** 3 counts go to every task; draws are dealt to tasks.
    """
    held = cells(pairs, None).toPandas()
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(held)

    def run(frames):
        c = shared.value
        for f in frames:
            out = []
            for d in f["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(d)]))
                a, b = np.zeros((k, k)), np.zeros((k, k))
                for y, g in c.groupby("y"):
                    n = g["n"].to_numpy()
                    w = rng.multinomial(n.sum(), n / n.sum())
                    np.add.at(a, (int(y), g["pred_a"].to_numpy()), w)
                    np.add.at(b, (int(y), g["pred_b"].to_numpy()), w)
                f1 = [np.nan_to_num(2 * np.diag(m) / np.maximum(m.sum(0) + m.sum(1), 1)).mean() for m in (a, b)]
                out.append((d, f1[0], f1[1], f1[1] - f1[0]))
            yield pd.DataFrame(out, columns=["draw", "macro_a", "macro_b", "delta"])

    return spark.range(draws).mapInPandas(run, "draw long, macro_a double, macro_b double, delta double")


def mean_draws(rows: DataFrame, value: str, draws: int, seed: object, key: str = "id", by=()) -> DataFrame:
    """(by, draw, mean, used, excluded): weighted means of finite values; excluded counts rows without one."""
    v = F.col(value)
    fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    drawn = with_draws(rows.where(fine).select(*by, key, value), draws).withColumn("w", poisson_weight(uniform(seed, "draw", key)))
    whole = rows.where(fine).select(*by, key, value, F.lit(-1).alias("draw"), F.lit(1).alias("w"))
    out = drawn.unionByName(whole).groupBy(*by, "draw").agg((F.sum(F.col("w") * v) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"), F.count("*").alias("used"))
    lost = rows.groupBy(*by).agg(F.count_if(~F.coalesce(fine, F.lit(False))).alias("excluded"))
    return out.join(lost.hint("merge"), list(by)) if by else out.join(F.broadcast(lost))


def auroc_draws(rows: DataFrame, draws: int, seed: object, group: str = "grp") -> DataFrame:
    """(draw, auroc) of (group, score, hit): groups weighted by Poisson(1), the same numbers as in ``cluster_draws``. Draw -1 is the table as it is.

    Scores are dealt to ranges; a task runs through its range in order and keeps, as arrays over draws, the weight of hits and misses and the
    area inside the range. Ranges are then laid end to end. Null scores take no part.
    """
    base = rows.where("score IS NOT NULL").groupBy(F.col(group).cast("string").alias("g"), F.col("score").cast("double").alias("score")).agg(
        F.sum("hit").cast("double").alias("pos"), F.sum(1 - F.col("hit")).cast("double").alias("neg")
    )
    return ranked_areas(base, draws, hashed(md5_numbers, poisson, seed))


def comparison_run(preds: DataFrame, comparisons: DataFrame, k: int, boot: int, rand: int, seed: object) -> DataFrame:
    """All declared comparisons (comparison, reference, candidate) in one plan: point, interval, p, Holm p and superiority, by comparison."""
    return comparisons_of(preds, comparisons, k, boot, rand, seed, numbers=md5_numbers)
