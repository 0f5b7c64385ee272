"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.order import positions
from cohortspark.sources.tables import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) with v < u, each u once per neighbour: hang u and its smaller neighbours on the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    hung = pairs.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v")))


def _large_star(pairs: DataFrame) -> DataFrame:
    """(u, v) with v < u: every neighbour of a node that is larger than the node hangs on its smallest neighbour."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, left: str = "left_id", right: str = "right_id", max_rounds: int = 60) -> DataFrame:
    """Rows (id, component) for every id of an edge; component is the smallest id of the connected component.

    Edges may repeat, run either way and be loops; edges with a null end are ignored. Only grouped minima and
    joins on the node are used, so state stays distributed; a round is written out, which bounds the lineage.
    The number of rounds grows with the logarithm of the longest chain.
    """
    pairs = (
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"), F.col(left).alias("l"), F.col(right).alias("r"))
        .where("l IS NOT NULL AND r IS NOT NULL")
        .select("u", "v")
        .distinct()
    )
    alone = pairs.where("u = v").select(F.col("u").alias("id"), F.col("v").alias("component"))
    links = materialize(pairs.where("u <> v"))
    seen = None
    for _ in range(max_rounds):
        links = materialize(_star(_large_star(links).distinct()).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("component"))
    )
    return members.unionByName(alone).groupBy("id").agg(F.min("component").alias("component"))


def numbered(components: DataFrame, pattern: str = "source_leakage_%04d") -> DataFrame:
    """Adds ``name``: components counted from 1 in order of their smallest id. The default pattern is a fixed value."""
    roots = positions(components.select("component").distinct(), (), [F.asc("component")], "_k")
    names = roots.select("component", F.format_string(pattern, F.col("_k")).alias("name"))
    return components.join(names.hint("merge"), "component")


def quarantine(table: DataFrame, members: DataFrame, reason: str, key: str = "id") -> DataFrame:
    """Adds ``eligible`` and ``reason`` ('' for eligible rows): members of ``members`` are not eligible."""
    marks = members.select(key, F.lit(True).alias("_in")).distinct()
    out = table.join(marks.hint("merge"), key, "left")
    return out.withColumn("eligible", F.col("_in").isNull()).withColumn("reason", F.when(F.col("_in"), reason).otherwise("")).drop("_in")


def audit_groups(table: DataFrame, edges: DataFrame, inherited: DataFrame, key: str = "id") -> DataFrame:
    """Adds grp, splits, quarantined: rows joined by edges are one group, and a group that lies in several splits or holds an
    inherited id is quarantined as a whole. Splits stay as they are."""
    found = connected_components(edges).select(F.col("id").alias(key), F.col("component"))
    rows = table.join(found.hint("merge"), key, "left").withColumn("grp", F.coalesce("component", key)).drop("component")
    rows = rows.join(inherited.select(key, F.lit(1).alias("_old")).distinct().hint("merge"), key, "left")
    groups = rows.groupBy("grp").agg(F.count_distinct("split").alias("splits"), F.max(F.coalesce("_old", F.lit(0))).alias("_bad"))
    return rows.drop("_old").join(groups.hint("merge"), "grp").withColumn("quarantined", (F.col("splits") > 1) | (F.col("_bad") == 1)).drop("_bad")
