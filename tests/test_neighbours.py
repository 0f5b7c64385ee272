"""Neighbours through buckets of projections: recall against brute force in numpy at two thresholds, crowded buckets and equal vectors."""

import numpy as np
import pytest

from cohortspark.operators import neighbours as N

N_ROWS, DIMS = 12_000, 32


def cloud(seed):
    """Clusters of all tightnesses; a third of all rows round one direction; five hundred equal rows."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((600, DIMS))
    v = middle[rng.integers(0, 600, N_ROWS)] + rng.standard_normal((N_ROWS, DIMS)) * rng.choice([0.1, 0.3, 0.6], N_ROWS)[:, None]
    v[: N_ROWS // 3] = 4 * np.ones(DIMS) + rng.standard_normal((N_ROWS // 3, DIMS)) * 0.8
    v[-500:] = v[-500]
    return v


def exact(v, split, least, top_k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for low in range(0, len(u), 2_000):
        c = u[low : low + 2_000] @ u.T
        c[split[low : low + 2_000, None] == split[None, :]] = -2
        order = np.argsort(-c, axis=1, kind="stable")[:, :top_k]
        for i, js in enumerate(order):
            for j in js:
                if c[i, j] >= least:
                    a, b = sorted((low + i, int(j)))
                    out[a, b] = c[i, j]
    return out


@pytest.mark.parametrize("least", [0.9, 0.6])
def test_recall(spark, least):
    v = cloud(1)
    split = np.array(["train", "val", "test"])[np.arange(N_ROWS) % 10 // 7 + (np.arange(N_ROWS) % 10 == 9)]
    df = spark.createDataFrame([(i, str(split[i]), v[i].tolist()) for i in range(N_ROWS)], "vec_id long, split string, features array<double>").repartition(8)
    got = {(r.left_id, r.right_id): r.cosine for r in N.hashed_neighbours(df, least, 5).collect()}
    want = exact(v, split, least, 5)
    assert len(want) > 10_000
    assert len(want.keys() & got.keys()) >= 0.9 * len(want)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for (a, b), c in list(got.items())[::50]:
        assert split[a] != split[b] and c == pytest.approx(float(u[a] @ u[b]), abs=1e-12) and c >= least


def test_odd_vectors(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "b", [2.0, 0.0]), (3, "b", [0.0, 0.0]), (4, "b", None), (5, "b", [float("nan"), 1.0]), (6, "b", [-1.0, 0.0]), (7, "a", [1.0, 0.1]), (8, "b", [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, split string, features array<float>")
    out = sorted((r.left_id, r.right_id) for r in N.hashed_neighbours(df, 0.5, 1).collect())
    assert out == [(1, 2), (1, 8), (2, 7)]
    assert N.hashed_neighbours(df.where("false"), 0.5, 3).count() == 0


def test_probes_come_by_distance():
    m = np.array([[0.1, -2.0, 0.5], [-0.3, 0.2, 0.1]])
    assert N.probes(m, 0, 3, 4).tolist() == [[0b101, 0b100, 0b001, 0b000], [0b110, 0b010, 0b100, 0b000]]
    assert N.probes(m, 1, 1, 4).tolist() == [[0, 1, -1, -1], [1, 0, -1, -1]]


def test_the_query_finds_what_the_exact_one_does(spark):
    from cohortspark.plans import registry

    ids = lambda name: {(r.left_id, r.right_id) for r in registry.queries()[name](spark, "/root/testdata/sf0.001").collect()}
    found, want = ids("hashed_neighbours"), ids("embedding_neighbours")
    assert len(want) > 0 and len(found & want) >= 0.9 * len(want)


def frame(spark, v, split):
    return spark.createDataFrame([(i, str(split[i]), v[i].tolist()) for i in range(len(v))], "vec_id long, split string, features array<double>").repartition(8)


def test_recall_by_buckets(spark, monkeypatch):
    """The same by buckets alone, crowded ones split by further signs, where a whole comparison would cost less."""
    monkeypatch.setattr(N, "SHARE", 1e9)
    monkeypatch.setattr(N, "BUCKET", 32)
    needed, asked = N.tables_needed, []
    monkeypatch.setattr(N, "tables_needed", lambda *a: asked.append(needed(*a)) or asked[-1])
    v = cloud(2)
    split = np.array(["train", "val", "test"])[np.arange(N_ROWS) % 10 // 7 + (np.arange(N_ROWS) % 10 == 9)]
    got = {(r.left_id, r.right_id): r.cosine for r in N.hashed_neighbours(frame(spark, v, split), 0.8, 5).collect()}
    want = exact(v, split, 0.8, 5)
    assert 1 <= asked[0][0] <= N.TABLES and asked[0][1] >= 0.95
    assert len(want.keys() & got.keys()) >= 0.9 * len(want)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(split[a] != split[b] and c == pytest.approx(float(u[a] @ u[b]), abs=1e-12) for (a, b), c in list(got.items())[::50])


def test_all_are_compared_where_buckets_spare_nothing(spark):
    """Neighbours no nearer than most rows: every pair is found, of rows without a split none."""
    v = np.random.default_rng(3).standard_normal((6_000, 32))
    split = np.array(["train", "val", "test"])[np.arange(6_000) % 10 // 7 + (np.arange(6_000) % 10 == 9)]
    odd = spark.createDataFrame([(6_000, None, v[0].tolist())], "vec_id long, split string, features array<double>")
    got = {(r.left_id, r.right_id) for r in N.hashed_neighbours(frame(spark, v, split).union(odd), 0.5, 5).collect()}
    assert got == exact(v, split, 0.5, 5).keys()


def shuffled(spark):
    """Bytes written for shuffles by all stages so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_shuffle_grows_with_the_rows(spark):
    """Four times the rows need more tables, but a row is sent as often as before."""
    v = np.random.default_rng(4).standard_normal((12_000, 32))
    split = np.where(np.arange(12_000) % 10 < 8, "train", "test")
    sent = []
    for n in (3_000, 12_000):
        df, before = frame(spark, v[:n], split[:n]).localCheckpoint(), shuffled(spark)
        assert N.hashed_neighbours(df, 0.55, 5).count() > 100
        sent.append(shuffled(spark) - before)
    assert sent[1] < 4.4 * sent[0]
