"""Fitted models: labels that training never saw, and subword averages one letter at a time."""

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import langid, quality


def test_quality_of_held_out_labels(spark):
    """A third of the labels is kept from training; documents with these are scored by what the others taught."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    out = quality.score(docs, quality.train(docs, labels.where(kept))).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"))
    held = out[[zlib.crc32(str(d).encode()) % 3 == 0 for d in out["doc_id"]]]
    assert len(held) > 300
    right = held["keep"].astype(bool) == (held["quality"] == 1)
    assert right.mean() > 0.97 and right[held["quality"] == 0].mean() > 0.9 and right[held["quality"] == 1].mean() > 0.95


def plain_buckets(text):
    """Buckets of all runs of three and four bytes round a letter, by the definition."""
    letters = [b if 97 <= b <= 122 or b >= 128 else 0 for b in text.lower().encode()]
    padded, out = [0, 0, *letters, 0, 0, 0, 0], []
    for k in range(len(letters) + 2):
        a, b, c, d = padded[k : k + 4]
        if b and (a or c):
            out.append(((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 17)
            if c:
                out.append((((a << 16 | b << 8 | c) << 8 | d) * 0x85EBCA77 & 0xFFFFFFFF) >> 17)
    return out


def test_subwords_and_logits_are_brute_force():
    rng = random.Random(1)
    pool = ["the", "der", "é", "straße", " ", "  ", "\n", "1", "x", "¿qué?", "中", "A"]
    texts = ["", "a", "ab", None, *("".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(300)), "lorem ipsum " * 3_000]
    table = np.random.default_rng(2).standard_normal((1 << 15, 3))
    model = langid.Model(["x", "y", "z"], table, np.array([0.1, -0.2, 0.3]))
    seen = 0
    for first, last, buckets, ends in langid.subwords(pa.array(texts)):
        logits, at = model.logits(buckets, ends), 0
        for row, end in zip(range(first, last), ends, strict=True):
            want = plain_buckets(texts[row] or "")
            assert sorted(buckets[at:end].tolist()) == sorted(want)
            mean = table[want].mean(axis=0) if want else np.zeros(3)
            assert logits[row - first] == pytest.approx((mean + model.bias).tolist())
            at, seen = end, seen + 1
    assert seen == len(texts)
