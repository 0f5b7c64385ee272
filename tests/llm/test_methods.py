"""The registered queries on a small table, against brute force, exact round trips or held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from cohortspark.llm import fingerprint, html as pages, jaccard, mixing, neighbours, packing, pii, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def run(spark, name, sf=SF):
    return queries.queries()[name](spark, sf).toPandas()


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def components(sets):
    best = {d: d for d in sets}

    def root(d):
        while best[d] != d:
            d = best[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                best[y] = x
    return {d: root(d) for d in ids}


def test_jaccard_is_brute_force(spark, docs):
    sets = {d: shingles(t) for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    want = components({d: s for d, s in sets.items() if s})
    out = run(spark, "op10_jaccard")
    assert dict(zip(out["doc_id"], out["component_id"], strict=True)) == want
    assert dict(zip(out["doc_id"], out["n_shingles"], strict=True)) == {d: len(s) for d, s in sets.items()}


def test_jaccard_at_the_threshold_and_in_a_large_group(spark):
    """Copies that differ in a few words, hubs, and pairs just over and under three quarters."""
    rng = np.random.default_rng(3)
    rows = []
    base = [f"w{k}" for k in range(80)]
    for k in range(150):
        words = list(base)
        for j in rng.choice(80, int(rng.integers(0, 4)), replace=False):
            words[j] = f"x{k}_{j}"
        rows.append((k, " ".join(words)))
    for k, cut in enumerate(range(20, 40)):
        rows += [(1000 + 2 * k, " ".join(f"p{k}_{j}" for j in range(cut + 100))), (1001 + 2 * k, " ".join(f"p{k}_{j}" for j in range(100)))]
    want = components({d: shingles(t) for d, t in rows})
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(out["doc_id"], out["component_id"], strict=True)) == want


def test_jaccard_of_one_id_in_two_spellings(spark):
    """Rows of one doc_id with equal sets are one side of a pair: documents 1 and 2 share half of their words and don't link."""
    block = lambda x: " ".join(f"{x}{k}" for k in range(30))
    one = f"{block('r')} {block('b')}"
    rows = [(1, one), (1, one.upper()), (2, f"{block('r')} {block('c')}")] + [(3 + k, f"{block('bc'[k % 2])} {block(f'u{k}x')}") for k in range(8)]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (out["component_id"] == out["doc_id"]).all()


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    out = run(spark, "op2_packing")
    tok = Tokenizer.from_file(packing.vocabulary())
    want = []
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    x = out.sort_values(["sequence_id", "offset"])
    assert ((x["offset"] + x["length"]).shift(1).where(x["sequence_id"] == x["sequence_id"].shift(1), 0) == x["offset"]).all()
    per = x.groupby("sequence_id")["length"].sum()
    assert per.max() <= 2048 and len(per) <= 1.05 * out["length"].sum() / 2048 + 2


@pytest.mark.parametrize("text", ["<|startoftext|>a<|endoftext|>", "It's they'll I'M", "áb  x y", "é.é", "\x1ca\x1db", "ÀÉ'S  !!x", "1234 a1b2", "don't,stop.now!", "İẞ", "x​y"])
def test_word_encoder_is_the_tokenizer(text):
    encode = packing.encoder(packing.vocabulary())
    assert np.frombuffer(encode(text.encode()), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_plan_places_everything():
    rng = np.random.default_rng(0)
    for top in (50, 700, 2048):
        histogram = np.zeros(2049, np.int64)
        np.add.at(histogram, rng.integers(1, top + 1, 3000), rng.integers(1, 4, 3000))
        planned = packing.plan(histogram)
        back = np.zeros_like(histogram)
        for pattern, n in planned:
            assert sum(a * b for a, b in pattern) <= 2048
            for length, times in pattern:
                back[length] += n * times
        assert (back == histogram).all()
        least = max((histogram * np.arange(2049)).sum() / 2048, histogram[1025:].sum())
        assert sum(n for _, n in planned) <= 1.02 * least + 2


@pytest.fixture(scope="module")
def field():
    return pii.train()


@pytest.mark.parametrize("address", ["info (at) shop.example.com", "max (at) firma.example.de"])
def test_pii_finds_addresses_without_digit_or_sign(spark, field, address):
    text = f"reach us: {address} any time"
    assert [text[a:b] for _, a, b in pii.find([text], field)[0][1]] == [address]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.detect(docs).first().spans == f"email:10:{10 + len(address)}"
    assert pii.mask(docs).first().text == "reach us: [EMAIL] any time"


def test_pii_windows_cut_nothing(field):
    """A long list of numbers is decoded as one sequence: each number is found whole, wherever it stands."""
    for more in range(4):
        text = f"dial 425-555-0142 for help, please{' now' * more}. " * 500
        want = [(3, m.start(), m.end()) for m in re.finditer("425-555-0142", text)]
        assert pii.find([text], field)[0][1] == want


def test_pii_windows_are_the_whole_text(field):
    rng = np.random.default_rng(4)
    bits = ["call 425-555-0142 now. ", "write to info (at) shop.example.com any time. ", "lorem ipsum dolor sit amet, ", "we met at noon, ", "x\u00b2 = 5\u00b2, ", "version 22 runs since 09/11. "]
    for _ in range(20):
        text = "".join(bits[k] for k in rng.integers(0, len(bits), 80))
        tokens = pii.TOKEN.findall(text)
        whole = pii.entities(pii.viterbi([pii.features(tokens)], *field)[0], 0, tokens)
        assert pii.find([text], field)[0][1] == sorted(x for x in whole if pii.plausible(x[0], text[x[1] : x[2]]))


def test_pii_base_is_the_plain_expression(spark, docs):
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        return kind == 0 or kind == 1 and all(int(p) <= 255 for p in s.split(".")) or kind == 2 and 16 <= len(d) <= 19 and pii.luhn(d) or kind == 3 and 8 <= len(d) <= 15

    odd = ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "4111 1111-1111 1111 2", "+1 (425) 555-0100 +1", "x@y x@@y.z a.b@c.d.", "1  23 4-5", "+12345678901234567"] * 2
    texts = [*docs["text"].fillna("").tolist(), *odd]
    for text, (base, every) in zip(texts, pii.find(texts, pii.train()), strict=True):
        want = [(k, m.start(), m.end()) for k, p in enumerate(plain) for m in re.finditer(p, text) if ok(k, m[0])]
        assert base == want and set(base) <= set(every)
    out = run(spark, "op4_pii").set_index("doc_id")
    text = docs.set_index("doc_id")["text"]
    for d in out.index[:50]:
        base = pii.base_spans(text[d] or "")
        assert out.loc[d, "base_sha256"] == hashlib.sha256(pii.told(base).encode()).hexdigest()


def test_pii_adds_what_patterns_miss():
    model = pii.train()
    texts = ["call (312) 555-0147 today", "in 1998 we paid 12,500 for 3.75 each", "Apache License, Version 2.0."]
    found = [[(pii.KINDS[k], t[a:b]) for k, a, b in every] for t, (_, every) in zip(texts, pii.find(texts, model), strict=True)]
    assert found == [[("phone", "(312) 555-0147")], [], []]
    wrong = sum((pii.viterbi([pii.features(tokens)], *model)[0] != labels).sum() for tokens, labels in map(pii.parse_labelled, pii.LABELLED))
    assert wrong <= 2


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = run(spark, "op3_langid", sf).merge(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "lang"]])
    held = out[out["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in held["doc_id"]]).all()
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97


def test_quality_separates_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = run(spark, "op7_quality", sf).merge(pd.read_parquet(f"{sf}/labels.parquet"))
    assert out[out["quality"] == 1]["keep"].mean() > 0.98 and out[out["quality"] == 0]["keep"].mean() < 0.1


def test_both_views_teach(spark):
    sf = "/root/testdata/sf0.1"
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.passed["text"] > 50 and model.passed["meta"] > 50


def test_fingerprints_are_brute_force(spark, docs):
    out = run(spark, "op8_fingerprint").set_index("doc_id")
    d = docs.sort_values("doc_id", ascending=False)
    texts = d["text"].fillna("").tolist()
    for i, own, following in zip(d["doc_id"], texts, texts[1:] + texts[:1], strict=True):
        new = fingerprint.edited(own, following)
        assert out.loc[i, "edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and out.loc[i, "n_chars"] == len(own)
        for column, other in (("near_edited", new), ("near_next", following)):
            a, b = fingerprint.piece_keys(own), fingerprint.piece_keys(other)
            want = 1 - len(np.setxor1d(a, b)) / (len(a) + len(b)) if len(a) + len(b) else 1.0
            assert out.loc[i, column] == pytest.approx(want)


def test_one_more_character_changes_one_piece():
    rng = np.random.default_rng(2)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(400))[:2000]
    for own in (text, text.replace(" ", "")):
        a, b = fingerprint.piece_keys(own), fingerprint.piece_keys("x" + own)
        assert len(a) >= 8 and fingerprint.likeness([a], [b])[0] >= 0.8
    assert fingerprint.pieces("one\n\n  two \r\nthree") == [b"one", b"two", b"three"]
    assert b"".join(fingerprint.pieces(text)) == text.encode()


def test_peeling_recovers_the_difference_and_grows_when_stuck():
    rng = np.random.default_rng(5)
    keys = rng.integers(1, 1 << 63, 4000, dtype=np.uint64)
    pairs = [(np.unique(keys[:a]), np.unique(keys[b : a + c])) for a, b, c in ((10, 2, 3), (500, 100, 200), (3000, 0, 1000), (0, 0, 0), (5, 0, 0))]
    assert fingerprint.differences(*map(list, zip(*pairs, strict=True))).tolist() == [len(np.setxor1d(a, b)) for a, b in pairs]
    whole, _, found, sign = fingerprint.peel(*(x - y for x, y in zip(fingerprint.sketches([pairs[0][0]], 48), fingerprint.sketches([pairs[0][1]], 48), strict=True)))
    assert whole[0] and set(found[sign > 0]) == set(pairs[0][0]) - set(pairs[0][1])


def recall(out, x, ids):
    hit = 0
    for q, g in out.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(g["vec_id"]))
        assert g.sort_values("rank")["score"].is_monotonic_increasing and g["rank"].tolist() == list(range(1, 11))
        assert g["score"].to_numpy() == pytest.approx(np.array([d[ids == v][0] for v in g["vec_id"]]), rel=1e-12)
    assert out["query_id"].nunique() == (ids % 100 == 0).sum()
    return hit / (10 * out["query_id"].nunique())


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    out = run(spark, "op6_neighbours", sf)
    m = pd.read_parquet(f"{sf}/embeddings.parquet")
    assert recall(out, np.stack(m["embedding"]).astype(float), m["vec_id"].to_numpy()) >= 0.9


def test_neighbours_recall_beyond_the_sample(spark):
    """The index is fitted on a tenth of the rows; half of these lie in one dense cluster."""
    rng = np.random.default_rng(8)
    n, dim = 20_000, 40
    centres = rng.normal(size=(60, dim)) * 2
    x = centres[np.where(rng.random(n) < 0.5, 0, rng.integers(0, 60, n))] + rng.normal(size=(n, dim))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    out = neighbours.search(frame, sample_rows=2000).toPandas()
    assert recall(out, x, np.arange(n)) >= 0.9


def test_pages_keep_the_article_only(spark):
    out = run(spark, "op9_html").merge(pd.read_parquet(f"{SF}/pages.parquet"), on="page_id")
    import html

    for text, page in zip(out["text"], out["html"], strict=True):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert text == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='search'><article><p>the whole article</p></article></div><footer>x</footer>", "the whole article"),
        ("<article><p>one</p><div class='side-effects'><p>two</p></div><div class='ad'>buy</div><aside>no</aside></article>", "one\ntwo"),
        (f"<body class='has-sidebar'><div class='content with-sidebar'><p>{'word, ' * 30}</p><div class='sidebar'>links</div></div><div class='comments'><p>{'no ' * 200}</p></div></body>", ("word, " * 30).strip()),
        (f"<form id='aspnet-form'><div><p>{'text ' * 30}</p></div></form><nav>menu</nav>", ("text " * 30).strip()),
        ("<nav>menu</nav><footer>foot</footer>", ""),
        ("<article><p>a</p><article class='comment'><p>I agree</p></article></article>", "a"),
        ("<div>" * 100_000 + "<p>deep</p>", "deep"),
    ],
)
def test_pages_are_cut_by_score_not_by_words_alone(html, text):
    page = pages.Page(html)
    assert page.extract(None) == text
    assert page.extract(page.path_of(page.best()[0])) == text


def test_mixing_takes_what_is_expected(spark):
    """Over many seeds, every document is taken as often as its source's share says; the registered query meets its contract."""
    sizes = [(k, f"s{k % 3}", " ".join(["w"] * (1 + k % 7))) for k in range(60)]
    docs = spark.createDataFrame(sizes, "doc_id long, source string, text string")
    runs = [mixing.mix(docs, seed=s).toPandas().assign(seed=s) for s in range(40)]
    every = pd.concat(runs)
    every["due"] = every["target"] / every["source_size"] * every["size"]
    by = every.groupby("doc_id").agg(taken=("taken", "mean"), due=("due", "first"), size=("size", "first"))
    assert (abs(by["taken"] - by["due"]) / by["size"]).max() < 0.35 and abs((by["taken"] - by["due"]) / by["size"]).mean() < 0.1
    out = run(spark, "op1_mixing")
    assert (out["taken"] <= 3 * out["size"]).all() and (abs(out.groupby("source", dropna=False)["taken"].sum() - out.groupby("source", dropna=False)["target"].first()) <= 1).all()


def test_pipeline_stages(spark, docs):
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    table, frames = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        table = corpus_pipeline.materialize(stage(spark, table, SF))
        frames.append(table.toPandas())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert table.columns == list(docs.columns)
    good, single, clean, mixed, packed = frames
    low = set(labels[labels["quality"] == 0]["doc_id"])
    assert len(low & set(good["doc_id"])) <= 0.2 * len(low) and len(good) >= 0.7 * len(docs)
    want = components({d: s for d, t in zip(good["doc_id"], good["text"], strict=True) if (s := shingles(t))})
    assert set(single["doc_id"]) == set(want.values()) | {d for d in good["doc_id"] if d not in want}
    assert set(clean["doc_id"]) == set(single["doc_id"]) and not any(pii.base_spans(t) for t in clean["text"])
    assert set(mixed["text"]) <= set(clean["text"]) and mixed.groupby("doc_id").size().max() <= 3
    assert set(packed["doc_id"]) == set(mixed["doc_id"]) and packed.groupby("sequence_id")["length"].sum().max() <= 2048


def test_frequent_shingles_stand_out_of_full_cells(spark):
    """With 2 ** 17 cells of some 300 members each, a passage of 200 documents is told from the rest, and its order doesn't change the links."""
    rng = np.random.default_rng(11)
    bits = 17
    common = rng.integers(0, 1 << 64, 50, dtype=np.uint64)
    rows = []
    for part in range(20):
        members = [rng.integers(0, 1 << 64, 2_000_000, dtype=np.uint64), *[common] * 40]
        rows.append([jaccard._counted(members, bits), sum(map(len, members))])
    tables = [(None, n, None, *x) for (told, n) in rows for x in [(None, None, None, None)]]
    tables += [(None, None, None, b, c, m, k) for told, _ in rows for b, c, m, k in zip(*(t.to_pylist() for t in told), strict=True)]
    described = spark.createDataFrame(tables, f"doc_id long, n_shingles long, node long, {jaccard.COUNTED}")
    known = jaccard.frequent(described, bits)
    usual = sum(n for _, n in rows) / (1 << bits)
    assert usual > 300 and (known.levels(np.sort(common)) > 0).all()
    other = np.sort(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    assert (known.levels(other) > 0).mean() < 0.01
    assert len(jaccard.frequent(described, bits, most=10).cells) <= 10


def test_jaccard_does_not_depend_on_the_cells(spark, docs):
    frame = spark.createDataFrame(docs[["doc_id", "text"]])
    want = {tuple(r) for r in jaccard.jaccard_components(frame).collect()}
    assert {tuple(r) for r in jaccard.jaccard_components(frame, bits=16).collect()} == want
