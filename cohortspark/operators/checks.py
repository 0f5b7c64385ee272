"""Constraints on tables. Each returns the violations, so an empty result means that the constraint holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.sources.tables import materialize, sized


def enforce(violations: DataFrame, what: str) -> None:
    """Raises with a few examples if there is a violation."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def missing_columns(table: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in table.columns]


def blanks(table: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, column) of null or blank values in required columns."""
    names = F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required])
    return table.select(key, F.explode(F.filter(names, lambda x: x.isNotNull())).alias("column"))


def repeated(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def domain(table: DataFrame, column: str, allowed: DataFrame, by=()) -> DataFrame:
    """(by, value, problem): values that aren't allowed, and allowed ones that a group lacks. ``allowed`` has one column, value."""
    have = table.select(*by, F.col(column).alias("value")).distinct()
    known = allowed.select("value").distinct().hint("merge")
    extra = have.join(known, "value", "left_anti").withColumn("problem", F.lit("unknown"))
    if not by:
        lack = known.join(have.hint("merge"), "value", "left_anti").withColumn("problem", F.lit("absent"))
        return extra.select("value", "problem").unionByName(lack)
    listed = sized(materialize(known))
    wanted = have.select(*by).distinct()
    lack = wanted.join(listed).join(have.hint("merge"), [*by, "value"], "left_anti").withColumn("problem", F.lit("absent"))
    return extra.select(*by, "value", "problem").unionByName(lack)


def expected_counts(table: DataFrame, by: list[str], expected: DataFrame) -> DataFrame:
    """(by, n, expected) of groups whose row count differs from the declared one."""
    have = table.groupBy(*by).agg(F.count("*").alias("n"))
    both = have.join(expected.hint("merge"), by, "full_outer").na.fill(0, ["n", "expected"])
    return both.where("n <> expected")


def not_one_to_one(table: DataFrame, a: str, b: str) -> DataFrame:
    """(side, value, partners) of values of either column that go with several of the other."""
    one = lambda x, y: table.groupBy(F.col(x).cast("string").alias("value")).agg(F.count_distinct(y).alias("partners")).where("partners <> 1").select(F.lit(x).alias("side"), "value", "partners")
    return one(a, b).unionByName(one(b, a))


def union_mismatch(parts: list[DataFrame], whole: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids in several parts, ids of the parts that the whole lacks, and the other way round."""
    tagged = reduce(DataFrame.unionByName, [p.select(key, F.lit(k).alias("part")) for k, p in enumerate(parts)])
    overlap = tagged.groupBy(key).agg(F.count_distinct("part").alias("n")).where("n > 1").select(key, F.lit("in several parts").alias("problem"))
    a, b = tagged.select(key).distinct(), whole.select(key).distinct()
    return overlap.unionByName(a.join(b.hint("merge"), key, "left_anti").withColumn("problem", F.lit("not in the whole"))).unionByName(b.join(a.hint("merge"), key, "left_anti").withColumn("problem", F.lit("in no part")))


def crossing(table: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups (or digests) with rows in more than one split."""
    return table.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")


def key_coverage(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, missing): keys that some of the tables lack, with the names of those."""
    rows = reduce(DataFrame.unionByName, [t.select(key).distinct().withColumn("name", F.lit(n)) for n, t in tables.items()])
    names = F.array(*[F.lit(n) for n in sorted(tables)])
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("have")).select(key, F.array_join(F.array_except(names, F.col("have")), ",").alias("missing")).where("missing <> ''")


def disagreements(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, left, right) where tables that share a key differ; null equals null."""
    both = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]).hint("merge"), key)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("string").alias("left"), F.col(f"b_{c}").cast("string").alias("right")) for c in columns])
    return both.select(key, F.explode(rows).alias("x")).select(key, "x.*").where("NOT (left <=> right)")


def leaks(held_out: DataFrame, development: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """(id, reason): held-out rows whose id, group or digest stands in the development table too."""
    found = [held_out.join(development.select(k).where(F.col(k).isNotNull()).distinct().hint("merge"), k, "left_semi").select(F.col(id_column), F.lit(k).alias("reason")) for k in keys]
    return reduce(DataFrame.unionByName, found)


def unbalanced(table: DataFrame, by: str, per_group: int) -> DataFrame:
    return table.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") != per_group)


def view_mismatch(views: DataFrame, declared: int) -> DataFrame:
    """(id, views, versions, sizes) of ids that aren't in every view once, or differ in split or label between views.

    ``views`` has (view, id, split, label, size): the rows of all feature tables together.
    """
    return (
        views.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("view").alias("views"), F.count_distinct(F.struct("split", "label")).alias("versions"))
        .where((F.col("n") != declared) | (F.col("views") != declared) | (F.col("versions") != 1))
    )
