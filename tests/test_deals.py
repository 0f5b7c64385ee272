"""Group folds and few-shot draws against plain versions that go through all groups one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cohortspark.operators import splits as J


def some_rows(groups, seed, classes="abc"):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        size = 1 if g % 3 else rng.choice([1, 2, 2, 3, 30])
        rows += [(len(rows) + k, g, rng.choice(classes)) for k in range(size)]
    return rows


def plain_folds(rows, folds, classes):
    counts = {}
    for _, g, y in rows:
        counts.setdefault(g, Counter())[y] += 1
    own = {g: [c[y] for y in classes] for g, c in counts.items()}
    totals = np.sum(list(own.values()), axis=0)
    held, out = np.zeros((folds, len(classes))), {}
    for g in sorted(own, key=lambda g: (-sum(own[g]), [-v for v in own[g]], g)):
        best = None
        for k in range(folds):
            then = held.copy()
            then[k] += own[g]
            rank = (round(float((then / totals).std(axis=0).mean()), 12), held[k].sum(), k)
            best = min(best or rank, rank)
        held[best[2]] += own[g]
        out[g] = best[2]
    return out, held


@pytest.mark.parametrize(("groups", "folds"), [(400, 3), (900, 5)])
def test_group_folds_are_brute_force(spark, groups, folds):
    rows = some_rows(groups, groups)
    want, held = plain_folds(rows, folds, "abc")
    for parts in (1, 6):
        df = spark.createDataFrame(rows, "id int, grp int, y string").repartition(parts)
        got = {r.grp: r.fold for r in J.stratified_group_folds(df, "grp", "y", folds).collect()}
        assert got == want
    assert (held.max(0) - held.min(0) <= 2).all()


def test_group_folds_of_many_groups(spark):
    """60,000 groups are one deal: classes are even over the folds, every group has one fold; null labels are a class."""
    df = spark.range(60_000).selectExpr("id AS grp", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('c', id % 4) END AS y")
    out = J.stratified_group_folds(df, "grp", "y", 4)
    sizes = out.join(df, "grp").groupBy("y", "fold").count().toPandas()
    assert out.count() == 60_000 and sizes["count"].sum() == 60_000
    assert all(f["count"].max() - f["count"].min() <= 1 and len(f) == 4 for _, f in sizes.groupby("y", dropna=False))
    assert J.stratified_group_folds(df.where("false"), "grp", "y", 4).count() == 0


def test_few_shot_draws_are_brute_force(spark):
    rows = some_rows(500, 9)
    budgets, repeats = [1, 7, 40], 3
    out = J.few_shot(spark.createDataFrame(rows, "id int, grp int, y string").repartition(5), "grp", "y", budgets, repeats, 4).collect()
    got = {(b, k): sorted(r.grp for r in out if (r.budget, r.repeat) == (b, k)) for b in budgets for k in range(repeats)}
    counts = {}
    for _, g, y in rows:
        counts.setdefault(g, Counter())[y] += 1
    for (b, k), taken in got.items():
        order = sorted(counts, key=lambda g: (int(hashlib.md5(f"4|{b}|{k}|{g}".encode()).hexdigest()[:8], 16), g))
        have, want = Counter(), []
        for g in order:
            if any(have[y] < b for y in counts[g]):
                want.append(g)
                have += counts[g]
        assert taken == sorted(want)


def test_few_shot_curve_grows(spark):
    from cohortspark.operators import heads as Z

    rng = random.Random(5)
    rows = [(k, k // 2, k % 3, "train" if k % 4 else "test", [rng.gauss(2.0 * (j == k % 3), 1) for j in range(3)]) for k in range(240)]
    draws, curve = Z.few_shot_curve(spark.createDataFrame(rows, "id long, grp long, y int, split string, features array<double>"), 3, [1, 20], 2, 1)
    out = {r.budget: r for r in curve.collect()}
    assert draws.count() == 4 and out[20].mean_accuracy > out[1].mean_accuracy and out[20].mean_rows >= 60 and out[1].repeats == 2


def test_hash_trees_find_the_changed_rows(spark):
    from cohortspark.functions import fields as B

    a = spark.range(3_000).selectExpr("id % 2 AS side", "id", "concat('t', id % 7) AS t").union(spark.sql("SELECT 0L, NULL, NULL"))
    tree = lambda df: {(r.side, r.prefix): r.digest for r in B.merkle(df, ["id", "t"], ("side",), (2, 1)).collect()}
    one = tree(a)
    assert one == tree(a.repartition(7)) and set(len(p) for _, p in one) == {0, 1, 2}
    changed = a.selectExpr("side", "id", "CASE WHEN id = 8 THEN 'x' ELSE t END AS t")
    other = tree(changed)
    assert one[1, ""] == other[1, ""] and one[0, ""] != other[0, ""] and 3 <= sum(one.get(k) != other.get(k) for k in one | other) <= 5
    twice = tree(a.union(a.where("id = 8")))
    assert twice[0, ""] != one[0, ""]


def test_bad_files_are_flagged(spark, tmp_path):
    from cohortspark.sources import files as A

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.bin").write_bytes(b"abc")
    (tmp_path / "d" / "none.bin").write_bytes(b"")
    paths = [f"file:{tmp_path}/d/{n}.bin" for n in ("one", "none", "gone")]
    out = {r.path.rsplit("/", 1)[1]: r for r in A.checked_digests(spark, str(tmp_path), spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert out["one.bin"].sha256 == hashlib.sha256(b"abc").hexdigest() and out["one.bin"].error is None
    assert out["none.bin"].error == out["gone.bin"].error == "absent" and out["gone.bin"].sha256 is None
