"""Ranks and running sums over groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.sources.tables import materialize, sized


def running(rows: DataFrame, by, order: list[Column], sums: dict[str, Column], totals: bool = False) -> DataFrame:
    """Adds for each of ``sums`` its sum from the group's first row in ``order`` to this row, and ``<name>_all`` over the group with ``totals``.

    Rows are dealt to ranges of (by, order) by sampled quantiles, so a group of any size and a value that many rows
    share (if ``order`` ends in a key) lie in many ranges. Rows are summed inside a range, and ranges are laid end to
    end by their own sums, of which there are a few per range. ``order`` must be total for sums that don't depend on chance.
    """
    by = list(by)
    ranged = materialize(rows.withColumns({f"_v{k}": c for k, c in enumerate(sums.values())}).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    own = [f"_v{k}" for k in range(len(sums))]
    group = by or [F.lit(1)]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    per = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in own])
    ahead = materialize(
        per.select(
            *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_range").alias("_of"),
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_ahead") for c in own],
            *[F.sum(c).over(whole).alias(f"{c}_all") for c in own if totals],
        )
    )
    same = F.col("_range") == F.col("_of")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(sized(ahead), same)
    out = {name: F.sum(c).over(inside) + F.col(f"{c}_ahead") for name, c in zip(sums, own, strict=True)}
    if totals:
        out |= {f"{name}_all": F.col(f"{c}_all") for name, c in zip(sums, own, strict=True)}
    return joined.select(*[F.col(c) for c in rows.columns if c not in out], *[v.alias(name) for name, v in out.items()])


def positions(rows: DataFrame, by, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the row's place from 1 in its group."""
    return running(rows, by, order, {name: F.lit(1)})
