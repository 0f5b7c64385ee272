"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from cohortspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "null"
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.6g}"  # the sign of zero counts
    return str(x)


def rows(frame, columns):
    return sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, sql, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = sql.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_the_entry_runs(spark):
    assert registry.flagship(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_every_group_gets_a_fold(spark):
    out = registry.queries()["stratified_group_folds"](spark, SF).toPandas()
    groups = {r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().collect()}
    assert len(out) == len(groups) and set(out["grp"]) == groups and set(out["fold"]) == {0, 1, 2}
