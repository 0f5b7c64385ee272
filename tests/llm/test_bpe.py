"""Byte-pair encoding by prefixes, against the library on whole tables, odd texts and every code point."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortspark.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


def ids_of(texts):
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    own = bpe.encoder(bpe.vocabulary())
    ids, ends = own.encode(np.frombuffer(b"".join(raw), np.uint8), at)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)], own.decode(ids, ends)


def agree(library, texts):
    got, back = ids_of(texts)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    assert [b.decode() for b in back] == library.decode_batch(want, skip_special_tokens=False)


def test_query_is_the_library(spark, library):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]
    out = queries.queries()["op12_bpe"](spark, SF).toPandas().set_index("doc_id")
    assert len(out) == len(docs)
    for doc, text in docs.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        told = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert tuple(out.loc[doc, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), told, decoded)


def test_odd_texts(library):
    rng = random.Random(11)
    pool = ["a", "aa", " ", "  ", "\n", "\t", "\r\n", "'s", "'re", "'", "''", "don't", "we'll", "<|endoftext|>", "<|", "endoftext|>", "é", "1", "22", "١", "!", "-=", "中文", " ", "　", "́", "\U0001f600", "the", "ing", "\x00", "x" * 70]
    agree(library, ["", *("".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(20_000))])


def test_words_of_repeats(library):
    rng = random.Random(12)
    texts = ["".join(rng.choices("ab", k=rng.randint(1, 40))) for _ in range(5_000)]
    texts += ["".join(rng.choices("etaoinshr", k=rng.randint(1, 90))) for _ in range(5_000)]
    agree(library, texts + [c * n for c in ("=", "-", "ab", "é", " ") for n in range(1, 300, 7)])


def test_every_code_point(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    agree(library, ["".join(points[k : k + 64]) for k in range(0, len(points), 64)])


def test_long_words_and_texts(library):
    rng = random.Random(13)
    agree(library, ["x" * 20_000, "".join(rng.choices("abcdefgh", k=20_000)), "lorem ipsum " * 50_000])


def test_full_memories_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 50)
    rng = random.Random(14)
    own = bpe.PrefixEncoder(bpe.vocabulary())
    for _ in range(20):
        texts = ["".join(rng.choices("abcde ", k=60)) for _ in range(5)]
        raw = [t.encode() for t in texts]
        ids, ends = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert ids.tolist() == [i for x in library.encode_batch(texts, add_special_tokens=False) for i in x.ids]
        assert ends[-1] == len(ids)


def test_table_cases(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (None, "no id", "c"), (3, "twice", "d"), (3, "twice", "d"), (4, "lorem ipsum " * 30_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("n_tokens", F.lit("clash"))
    out = bpe.encode_digests(docs).toPandas()
    assert sorted(out["n_tokens"]) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
    assert set(out[out["n_tokens"] == 0]["ids_sha256"]) == {hashlib.sha256(b"").hexdigest()}
    assert out["doc_id"].isna().sum() == 1
    back = bpe.decode(bpe.encode(docs)).toPandas()
    assert sorted(back["text"]) == sorted(t or "" for _, t, _ in rows)
    none = docs.where("false")
    assert bpe.encode_digests(none).count() == 0 and bpe.decode(bpe.encode(none)).count() == 0
