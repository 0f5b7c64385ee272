"""Folds, samples and quotas that don't depend on row order or partitioning: random order is a hash of seed and id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators.order import positions
from cohortspark.sources.tables import materialize, sized


def draw(seed: object, *keys: str) -> Column:
    """A 32-bit number that depends on the seed and the keys alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def stable_seed(*parts: Column, wide: bool = True) -> Column:
    """A seed from parts: SHA-256 of their texts, of its first eight bytes the low 32 bits (``wide``) or its first four bytes."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 9 if wide else 1, 8), 16, 10).cast("bigint")


def _order(seed: object, key: str) -> list[Column]:
    return [draw(seed, key), F.col(key)]


def stratified_folds(rows: DataFrame, label: str, folds: int, seed: object, key: str = "id") -> DataFrame:
    """Adds ``fold``: each label's rows in hash order, dealt round."""
    placed = positions(rows, [label], _order(seed, key), "_at")
    return placed.withColumn("fold", ((F.col("_at") - 1) % folds).cast("int")).drop("_at")


def group_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """Adds ``fold``: groups by falling size, dealt to and fro."""
    sizes = positions(rows.groupBy(group).agg(F.count("*").alias("_n")), (), [F.desc("_n"), F.asc(group)], "_at")
    at = F.col("_at") - 1
    lap, k = F.floor(at / folds), at % folds
    dealt = sizes.select(group, F.when(lap % 2 == 0, k).otherwise(folds - 1 - k).cast("int").alias("fold"))
    return rows.join(dealt.hint("merge"), group)


def stratified_group_folds(rows: DataFrame, group: str, label: str, folds: int) -> DataFrame:
    """(group, fold): groups go one by one to the fold where the spread of class counts grows least, large ones first, of equal size by counts, then by name.

    Groups with the same class counts stand together, so only the distinct lists of counts go through the one task that deals, with
    how many groups have each: its state is a table of folds and classes. As soon as each fold is chosen once in a row of picks, the
    picks repeat until the counts change, so a list's picks are a beginning and a cycle. Groups take theirs by their place
    among those with the same counts. The folds don't depend on partitioning or size.
    """
    classes = [r[0] for r in rows.select(label).distinct().orderBy(label).collect()]
    own = rows.groupBy(group).agg(F.array(*[F.count_if(F.col(label).eqNullSafe(F.lit(c))) for c in classes]).alias("_v"), F.count("*").alias("_n"))
    own = materialize(own)
    runs = own.groupBy("_v", "_n").agg(F.count("*").alias("_m"))
    totals = np.array(own.select(*[F.sum(F.col("_v")[k]) for k in range(len(classes))]).first() or [], float)
    if not classes or totals[0] != totals[0]:
        return own.select(group, F.lit(0).alias("fold"))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, each = np.zeros((folds, len(classes))), np.eye(folds)[:, :, None]  # k-th table: the group added to fold k
        for f in frames:
            begins, cycles = [], []
            for v, m in zip(f["_v"], f["_m"], strict=True):
                row, picks, cycle = np.array(v, float), [], []
                while len(picks) < m:
                    spread = ((held + each * row) / totals).std(axis=1).mean(axis=1).round(12)
                    best = min(zip(spread, held.sum(axis=1), range(folds), strict=True))[2]
                    held[best] += row
                    picks.append(best)
                    if len(set(picks[-folds:])) == folds:
                        cycle = picks[-folds:]
                        laps, rest = divmod(int(m) - len(picks), folds)
                        held += laps * row
                        for k in cycle[:rest]:
                            held[k] += row
                        break
                begins.append(picks)
                cycles.append(cycle)
            yield f[["_v"]].assign(begin=begins, cycle=cycles)

    one = runs.repartition(1).sortWithinPartitions(F.desc("_n"), F.desc("_v"))
    dealt = materialize(one.select("_v", "_m").mapInPandas(deal, "_v array<bigint>, begin array<int>, cycle array<int>"))
    placed = positions(own, ["_v"], [F.asc(group)], "_at").join(dealt.hint("merge"), "_v")
    at, n = F.col("_at").cast("int"), F.size("begin")
    return placed.select(group, F.when(at <= n, F.get("begin", at - 1)).otherwise(F.get("cycle", F.pmod(at - n - 1, F.lit(folds)))).alias("fold"))


def fold_table(rows: DataFrame, folds: DataFrame, group: str, key: str = "id") -> DataFrame:
    """(fold, rows, groups, digest of the ids in order)."""
    from cohortspark.functions.fields import fingerprint

    joined = rows.join(folds.hint("merge"), group)
    return joined.groupBy("fold").agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups")).join(fingerprint(joined, key, by=("fold",)).hint("merge"), "fold")


def quotas(rows: DataFrame, label: str, total: int) -> DataFrame:
    """(label, n, quota): shares of ``total`` by largest remainder, one at least for each class, ties by label."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(1))
    exact = F.col("n") * F.lit(float(total)) / F.sum("n").over(everything)
    base = n.withColumn("_e", exact).withColumn("_q", F.greatest(F.floor("_e"), F.lit(1)))
    order = Window.orderBy(F.desc(F.round(F.col("_e") - F.floor("_e"), 9)), label)
    left = F.lit(total) - F.sum("_q").over(everything)
    return base.select(label, "n", (F.col("_q") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).alias("quota"))


def stratified_sample(rows: DataFrame, label: str, total: int, seed: object, key: str = "id") -> DataFrame:
    """``total`` rows by the quotas, each class's first in hash order. Smaller totals with the same seed give subsets, up to rounding of quotas."""
    q = F.broadcast(quotas(rows, label, total).select(label, "quota"))
    return positions(rows.join(q, label), [label], _order(seed, key), "_at").where("_at <= quota").drop("_at", "quota")


def nested_subsets(rows: DataFrame, label: str, sizes: list[int], seed: object, key: str = "id") -> DataFrame:
    """(size, key, label): for each size the prefix of one order per class, so that a smaller subset lies in every larger one."""
    everything = Window.partitionBy(F.lit(1))
    per = rows.groupBy(label).agg(F.count("*").alias("_n")).withColumn("_share", F.col("_n") / F.sum("_n").over(everything)).select(label, "_share")
    ordered = positions(rows.join(F.broadcast(per), label).select(key, label, "_share"), [label], _order(seed, key), "_at")
    size = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")
    return ordered.select("*", size).where(F.col("_at") <= F.greatest(F.floor(F.col("_share") * F.col("size") + 1e-9), F.lit(1))).select("size", key, label)


def fixed_test(rows: DataFrame) -> DataFrame:
    """Adds protocol_split: train and val are development, test stays test."""
    return rows.withColumn("protocol_split", F.when(F.col("split") == "test", "test").otherwise("development"))


def few_shot(rows: DataFrame, group: str, label: str, budgets: list[int], repeats: int, seed: object) -> DataFrame:
    """(budget, repeat, group): whole groups, in hash order, until every class has ``budget`` rows; a group is taken if it helps a class that is short.

    Draws work on the table (group, class, count). Rows of each class are first counted in bins of the hash; only the groups up to the bin
    where the budget is certainly met are ordered and taken, by a task for each draw.
    """
    counts = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    plan = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(k).alias("repeat")) for b in budgets for k in range(repeats)]))
    dealt = counts.select("*", plan.alias("p")).select(group, label, "n", "p.budget", "p.repeat")
    dealt = dealt.withColumn("_d", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "budget", "repeat", group)), 1, 8), 16, 10).cast("bigint"))
    # Only groups that can be reached matter: within each class, those before the budget is certainly met.
    draw_of = ["budget", "repeat", label]
    binned = dealt.withColumn("_bin", F.shiftright("_d", 20))  # 4,096 bins
    upto = Window.partitionBy(*draw_of).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # sees bins, not groups
    counted = binned.groupBy(*draw_of, "_bin").agg(F.sum("n").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    last = materialize(counted.where("_ahead < budget").groupBy(*draw_of).agg(F.max("_bin").alias("_last")))
    reached = binned.join(sized(last), draw_of).where("_bin <= _last")
    near = Window.partitionBy("budget", "repeat", label).orderBy("_d", group).rowsBetween(Window.unboundedPreceding, -1)
    useful = reached.withColumn("_before", F.coalesce(F.sum("n").over(near), F.lit(0))).where("_before < budget").select("budget", "repeat", group, "_d").distinct()
    wanted = dealt.join(useful.select("budget", "repeat", group).hint("merge"), ["budget", "repeat", group])
    kind = rows.schema[group].dataType.simpleString()

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        have, out = dict.fromkeys(pdf[label].unique(), 0), []
        budget = int(pdf["budget"].iloc[0])
        for (_, g), own in pdf.sort_values(["_d", group, label]).groupby(["_d", group], sort=True):
            if any(have[c] < budget for c in own[label]):
                out.append(g)
                for c, n in zip(own[label], own["n"], strict=True):
                    have[c] += int(n)
        return pd.DataFrame({"budget": budget, "repeat": int(pdf["repeat"].iloc[0]), group: out})

    return wanted.groupBy("budget", "repeat").applyInPandas(take, f"budget int, repeat int, {group} {kind}")


def balanced_strata(rows: DataFrame, strata: list[str], total: int, seed: object, key: str = "id") -> DataFrame:
    """``total`` rows, as many of each stratum; raises if ``total`` isn't divisible by the number of strata."""
    n = rows.select(*strata).distinct().count()
    if total % n:
        raise ValueError(f"{total} rows can't be dealt evenly to {n} strata")
    order = Window.partitionBy(*strata).orderBy(draw(seed, *strata, key), key)
    return rows.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= total // n).drop("_at")


def balanced_cohort(rows: DataFrame, label: str, per_class: int, seed: int, key: str = "id") -> DataFrame:
    """The first ``per_class`` rows of each class in order of SHA-256 of seed|id."""
    order = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(label).orderBy(order, key))).where(F.col("_at") <= per_class).drop("_at")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): inverse frequency, scaled to mean one."""
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(1))
    raw = F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
    return n.withColumn("_w", raw).withColumn("weight", F.col("_w") / F.avg("_w").over(everything)).drop("_w")
