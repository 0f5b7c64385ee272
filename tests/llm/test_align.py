"""Alignment of two tokenizers against a plain version that goes through whole texts, tokens and pairs one by one."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortspark.llm import align, bpe, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tools():
    a, b = align.vocabularies()
    first = Tokenizer.from_file(a)
    first.encode_special_tokens = True
    letters = bpe.byte_letters()
    with open(a, encoding="utf-8") as f:
        bytes_a = {i: bytes(letters.get(c, 63) for c in t) for t, i in json.load(f)["model"]["vocab"].items()}
    return first, bytes_a, sentencepiece.SentencePieceProcessor(model_file=b)


def groups_of(tools, text):
    first, bytes_a, second = tools
    if not text:
        return []
    whole = (" " + text).encode()
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    sides = []
    for ids, own in ((a, bytes_a.get), (b, lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode())):
        ends, at = [], 0
        for i in ids:
            at += len(own(i))
            ends.append(at)
        if b"".join(map(own, ids)) != whole:
            return []
        sides.append((ids, ends))
    cuts = sorted(set(sides[0][1]) & set(sides[1][1]))
    return [[[i for i, e in zip(ids, ends, strict=True) if low < e <= high] for ids, ends in sides] for low, high in zip([0, *cuts], cuts, strict=False)]


def brute(tools, texts):
    found = [groups_of(tools, t) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in found]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for g, own in zip(found, links, strict=True):
        told = ";".join("|".join(",".join(map(str, s)) for s in pair) for pair in g)
        yield (
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
            sum(n for (x, y), n in own.items() if count[x, y] == best[x]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(told.encode()).hexdigest() if g else "",
        )


def test_query_is_brute_force(spark, tools):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    out = queries.queries()["op13_align"](spark, SF).toPandas().set_index("doc_id")
    assert len(out) == len(docs)
    for doc, want in zip(docs["doc_id"], brute(tools, docs["text"]), strict=True):
        assert tuple(out.loc[doc, COLUMNS]) == want


ODD = [
    None, "", " ", "  ", "\n", "a", "a ", " a", "a  b", "a\n b \n\n  c", "don't  stop", "▁", "a▁b", "<s> </s> <unk> <0x41>", "<|endoftext|>", "中文 字 。", "à la é ß x", "a  b", "a　 b", "a  b", "tab\t x",
    "\x00 \x00", "\U0001f600 \U0001f600\U0001f600", "กำ x", "= " * 50, " " * 300, "x" * 1_000, "ab" * 600, "é" * 700, "=" * 999, "lorem ipsum " * 300, "twice", "twice",
]


def test_odd_texts(spark, tools, monkeypatch):
    """Also with several salts, parts that split, full memories and pairs expanded a few at a time."""
    rng = random.Random(3)
    pool = ["a", "the", " ", "  ", "\n", "'s", "é", "à", "中", " ", "\U0001f600", "1", "22", "!", "</s>", "<|endoftext|>", "\t", "\r\n", "qu", "zz", "-"]
    texts = ODD + ["".join(rng.choices(pool, k=rng.randint(1, 30))) for _ in range(400)]
    rows = [(None if k % 7 == 0 else k, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, row long").repartition(3)
    want = sorted((str(None if k % 7 == 0 else k), *x) for k, x in enumerate(brute(tools, texts)))
    told = lambda: sorted((str(None if pd.isna(r[0]) else int(r[0])), *r[1:]) for r in align.align(docs).select("doc_id", *COLUMNS).toPandas().itertuples(index=False))
    assert told() == want
    monkeypatch.setattr(align, "SLICES", 0.25)
    assert told() == want


def test_memories_and_blocks(tools, monkeypatch):
    monkeypatch.setattr(align, "STRETCHES_KEPT", 40)
    monkeypatch.setattr(align, "EXPANDED", 7)
    rng = random.Random(4)
    own = align.Aligner(*align.vocabularies())
    for _ in range(10):
        texts = [" " + "".join(rng.choices(["ab", "c", " ", "é", "\n"], k=40)) for _ in range(6)]
        raw = [t.encode() for t in texts]
        at = np.cumsum([0, *map(len, raw)])
        numbers, digests, text, pairs, times = own.texts(np.frombuffer(b"".join(raw), np.uint8), at)
        for k, t in enumerate(texts):
            g = groups_of(tools, t[1:])
            want = Counter((x, y) for a, b in g for x in a for y in b)
            mine = {(int(p) // own.wide, int(p) % own.wide): int(n) for p, n in zip(pairs[text == k], times[text == k], strict=True)}
            assert mine == want and numbers[k, 3] == len(g) and numbers[k, 4] == sum(want.values())


def test_counting_flushes(monkeypatch):
    monkeypatch.setattr(align, "COUNTED", 50)
    import pyarrow as pa

    rng = np.random.default_rng(1)
    loads, want = [], Counter()
    for _ in range(30):
        rows = np.unique(np.stack([rng.integers(0, 5, 60), rng.integers(0, 400, 60)], axis=1), axis=0)
        want.update(rows[:, 1].tolist())
        loads.append(align.pack(rows[:, 0], rows[:, 1], np.ones(len(rows), np.int64)))
    got = Counter()
    for b in align._count(iter([pa.RecordBatch.from_arrays([pa.array(loads, pa.binary())], ["load"])])):
        for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got[p] += n
    assert got == want


def test_galloping():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (np.unique(rng.integers(1, 200, rng.integers(1, 150))) for _ in range(2))
        x, y = align.common_ends(a, np.array([0, len(a)]), b, np.array([0, len(b)]))
        want = np.intersect1d(a, b)
        assert (a[x] == want).all() and (b[y] == want).all() and len(x) == len(want)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.align(none).count() == 0
