"""Near hashes confirmed for one row of each digest, lists of hashes compared as arrays, shares of letters."""

import hashlib
import random

import numpy as np
import pytest

from cohortspark.operators import pairs as D
from cohortspark.plans import q_audit as Q
from cohortspark.sources import fixtures as X

BASE = "the quick brown fox jumps over a lazy dog near some old river bank while many small birds sing in tall green trees"


def cohort():
    """(id, split, label, sha256, h32, original_name, text, source): 60 copies each of two near texts, 20 of one in a single split, others."""
    texts = [BASE] * 60 + [BASE + " ö"] * 60 + [f"{k} ä {'xyzw'[k % 4] * (k + 1)}" for k in range(30)] + [None, ""]
    out = []
    for k, t in enumerate(texts):
        sha = None if t is None else hashlib.sha256(t.encode()).hexdigest()
        h = (0b1011 << 8 | (t.endswith("ö") << 3)) if t and t.startswith("the") else (k + 1) * 2654435761 & 0xFFFFFFFF
        out.append((k, ("train", "train", "val", "test")[k % 4], "en", sha, h, None if sha is None else f"[en]_{sha}.jpg", t, "s"))
    one = BASE + " å"
    return out + [(200 + k, "train", "en", hashlib.sha256(one.encode()).hexdigest(), 0b1011 << 8 | 1, f"{k}_{one[:3]}.jpg", one, "s") for k in range(20)]


def near(rows, distance, least):
    thumb = {r[0]: None if r[6] is None else [r[6].count(c) / max(len(r[6]), 1) for c in "abcdefghijklmnopqrstuvwxyz"] for r in rows}
    out = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] != b[1] and (a[4] ^ b[4]).bit_count() <= distance and thumb[a[0]] and thumb[b[0]]:
                x, y = thumb[a[0]], thumb[b[0]]
                if max(x) == min(x) or max(y) == min(y) or np.corrcoef(x, y)[0, 1] >= least:
                    out.add((a[0], b[0]))
    return out


@pytest.fixture
def seen(monkeypatch):
    """How many pairs had their vectors compared."""
    counts, own = [], D.enriched

    def counted(pairs, *a, **b):
        counts.append(pairs.count())
        return own(pairs, *a, **b)

    monkeypatch.setattr(D, "enriched", counted)
    return counts


KINDS = "id long, split string, label string, sha256 string, h32 long, original_name string, text string, source string"


def test_confirmed_rows_are_brute_force(spark, seen, monkeypatch):
    monkeypatch.setattr(D, "MEMBERS", 8)
    rows = cohort()
    got = D.confirmed_near(Q.letters(spark.createDataFrame(rows, KINDS)), "h32", 32, "thumb", "nan", 2, 0.95).collect()
    want = near(rows, 2, 0.95)
    assert sorted((r.left_id, r.right_id) for r in got) == sorted(want) and len(want) > 5_000
    assert {r.rule for r in got} == {"distance<=2&correlation>=0.95"} and sum(seen) < 20


def test_an_audit_compares_copies_once(spark, seen):
    rows = cohort()
    got = {r.id: (r.grp, r.splits, r.quarantined) for r in Q.source_audit(spark.createDataFrame(rows, KINDS)).collect()}
    of = {r[0]: r[0] for r in rows}
    edges = near(rows, 3, 0.9) | {(a[0], b[0]) for a in rows for b in rows if a[3] is not None and a[3] == b[3]}
    while any(of[a] != of[b] for a, b in edges):
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    for i, s, *_ in rows:
        splits, bad = len({r[1] for r in rows if of[r[0]] == of[i]}), any(r[0] % 97 == 0 for r in rows if of[r[0]] == of[i])
        assert got[i] == (of[i], splits, splits > 1 or bad)
    assert len(got) == len(rows) and sum(seen) < 30


@pytest.mark.parametrize(("count", "bits", "radius"), [(3000, 14, 1), (1500, 32, 3), (900, 64, 6), (40, 5, 0)])
def test_lists_are_brute_force(monkeypatch, count, bits, radius):
    monkeypatch.setattr(D, "SMALL", 16)
    rng = random.Random(count)
    values = {rng.getrandbits(bits) for _ in range(count)}
    h = np.array(sorted(values | {v ^ 1 << rng.randrange(bits) ^ 1 << rng.randrange(bits) for v in list(values)[: count // 4]}), np.uint64)
    i, j = D.near_places(h, radius)
    a, b = np.nonzero(np.triu(np.bitwise_count(h[:, None] ^ h) <= radius, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == list(zip(a.tolist(), b.tolist(), strict=True))


def test_letter_shares(spark):
    texts = ["", None, "abz", "ä b!", "Zz" * 50_000]
    got = {r.id: r.s for r in spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", X.letter_shares("text").alias("s")).collect()}
    assert got == {k: None if t is None else [t.count(chr(97 + n)) / max(len(t), 1) for n in range(26)] for k, t in enumerate(texts)}


def test_a_long_text_votes_with_all_words(spark):
    text = " ".join(f"w{k % 90_000}" for k in range(100_000))
    votes = np.zeros(32, np.int64)
    for k in range(90_000):
        votes += 2 * (int(hashlib.md5(f"w{k}".encode()).hexdigest()[:8], 16) >> np.arange(32) & 1) - 1
    got = spark.createDataFrame([(0, "a"), (1, text), (2, "b")], "id int, text string").select("id", X.simhash("text").alias("h")).where("id = 1").first().h
    assert got == int(((votes > 0) << np.arange(32)).sum())
