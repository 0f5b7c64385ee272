"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.sources.tables import materialize, sized


def quantiles(rows: DataFrame, value: str, shares: list[float], by=(), name: str = "q") -> DataFrame:
    """(by, name): the quantiles of ``value`` at ``shares`` as an array, linear between the values at floor and ceiling of share * (n - 1).

    Equal values are counted first. Distinct ones are dealt to ranges by sampled borders, ranges are counted, and only those that hold
    a wanted rank are looked into. No buffer holds a group's values, and a value that most rows share is one row. Nulls don't count;
    a group without values has no row; without ``by`` there is always one, of nulls if there are no values.
    """
    by = list(by)
    keys = [f"_g{k}" for k in range(len(by))]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranged = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_range", F.spark_partition_id()))
    group = keys or [F.lit(1)]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_m"))  # a few rows for each range
    per = per.select(*keys, "_range", "_m", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_ahead"), F.sum("_m").over(Window.partitionBy(*group)).alias("_all"))
    at = [F.lit(float(s)) * (F.col("_all") - 1) for s in shares]
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(up).alias("up"), (F.ceil(p) if up else F.floor(p)).cast("bigint").alias("rank"), (p - F.floor(p)).alias("part")) for k, p in enumerate(at) for up in (False, True)])
    mine = F.filter(ranks, lambda r: (r["rank"] >= F.col("_ahead")) & (r["rank"] < F.col("_ahead") + F.col("_m")))
    holders = materialize(per.withColumn("_ranks", mine).where(F.size("_ranks") > 0).select(*[F.col(k).alias(f"{k}x") for k in keys], F.col("_range").alias("_of"), "_ahead", F.explode("_ranks").alias("_r")).select("*", "_r.*").drop("_r"))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}x"))
    upto = F.sum("_n").over(Window.partitionBy("_range", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    inside = ranged.join(sized(holders.select("_of", *[f"{k}x" for k in keys]).distinct()), same, "left_semi").withColumn("_upto", upto)
    hit = inside.join(sized(holders), same).where((F.col("_ahead") + F.col("_upto") > F.col("rank")) & (F.col("_ahead") + F.col("_upto") - F.col("_n") <= F.col("rank")))
    ends = hit.groupBy(*keys, "k").agg(F.max(F.when(~F.col("up"), F.col("_v"))).alias("a"), F.max(F.when(F.col("up"), F.col("_v"))).alias("b"), F.first("part").alias("part"))
    told = ends.select(*keys, "k", F.when(F.col("part") > 0, F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).otherwise(F.col("a")).alias("x"))
    whole = told.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("k") == k, F.col("x"))) for k in range(len(shares))]).alias(name))
    return whole.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], name)
