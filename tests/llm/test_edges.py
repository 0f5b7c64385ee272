"""Every operator with nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortspark.llm import chat, fingerprint, html, jaccard, langid, mixing, neighbours, packing, pii, quality

LONG = "lorem ipsum dolor " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken int, rank int, component string"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "   \t\n", "one", "a b c d e f g", LONG, "mail x@y.org now", "A b C d e F g", "a b c d e f g", "é ü 123 \U0001f600"]
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 == 0 else f"s{k % 3}", None if t is None else len(t), 1, 2, "x") for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (4, "other text under the same id", "de", "s1", 3, 1, 2, "x"), (None, "no id here", "de", "s2", 10, 1, 2, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, none):
    out = mixing.mix(docs).toPandas()
    assert len(out) == docs.count()
    assert (out["taken"] <= 3 * out["size"]).all()
    by = out.groupby("source", dropna=False)
    assert (abs(by["taken"].sum() - by["target"].first()) <= 1).all()
    assert out["target"].groupby(out["source"], dropna=False).first().sum() == pytest.approx(out["size"].sum())
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert set(mixed.select("text").toPandas()["text"]) <= set(docs.select("text").toPandas()["text"])
    assert sorted(mixing.mix(docs).toPandas().astype(str).values.tolist()) == sorted(out.astype(str).values.tolist())


def test_jaccard(docs, none):
    out = jaccard.jaccard_components(docs).toPandas()
    assert len(out) == docs.count()
    sizes = out.dropna().set_index("doc_id")
    assert sizes.loc[0, "n_shingles"] == 0 and sizes.loc[2, "component_id"] == 2 and sizes.loc[3, "n_shingles"] == 1
    assert set(sizes.loc[7, ["n_shingles", "component_id"]]) == {3, 4} and sizes.loc[8, "component_id"] == 4
    assert out[out["doc_id"].isna()]["component_id"].isna().all()
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.keep_one(docs).toPandas()
    assert list(kept.columns) == docs.columns
    assert sorted(kept["doc_id"].dropna()) == [0, 1, 2, 3, 4, 5, 6, 9] and kept["doc_id"].isna().sum() == 1
    assert jaccard.keep_one(none).count() == 0


CLASHES = ("copies", "_size", "_k", "_copy", "_n", "_at", "_first", "row", "n", "k", "h", "size", "part", "id", "digest", "wanted", "at", "y", "target", "salt", "host")


def test_columns_may_have_any_names(docs, none):
    odd = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    for change in (mixing.apply_mix, jaccard.keep_one, pii.mask, lambda d: quality.keep_good(d, quality.train(d, labels))):
        out = change(odd)
        assert out.columns == odd.columns
        rows = out.collect()
        assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in CLASHES)
        assert change(none.withColumns({c: F.lit(None).cast("string") for c in CLASHES})).count() == 0
    for look in (mixing.mix, jaccard.jaccard_components, packing.pack, pii.detect, fingerprint.compare_versions):
        assert sorted(map(str, look(odd).collect())) == sorted(map(str, look(docs).collect()))


def test_one_id_with_texts_of_two_groups(spark):
    """Of id 5, text A is alone and text B a near copy of document 2: B goes, A stays."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    docs = spark.createDataFrame([(5, a), (5, f"{b} more"), (2, b), (5, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()) == [(2, b), (5, a)]


def test_pipeline(spark, docs, none):
    sf = "/root/testdata/sf0.001"
    for table in (docs, none, docs.where("text IS NULL"), docs.where("doc_id IS NULL")):
        rows = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf)
            assert rows.columns == docs.columns
            rows = corpus_pipeline.materialize(rows)
        last = corpus_pipeline.STAGES[-1][1](spark, rows, sf).toPandas()
        if len(last):
            check_packed(last)
        assert len(last) >= rows.count() and set(last["doc_id"].dropna()) == {r.doc_id for r in rows.select("doc_id").collect() if r.doc_id is not None}


def test_packing(docs, none):
    out = packing.pack(docs).toPandas()
    assert out[out["doc_id"] == 0][["piece", "start", "length"]].values.tolist() == [[0, 0, 1]]
    assert out[out["doc_id"] == 5]["length"].max() == 2048 and (out[out["doc_id"] == 5]["piece"].sort_values().diff().dropna() == 1).all()
    check_packed(out)
    assert packing.pack(none).count() == 0


def check_packed(out):
    x = out.sort_values(["sequence_id", "offset"])
    ahead = (x["offset"] + x["length"]).shift(1).where(x["sequence_id"] == x["sequence_id"].shift(1), 0)
    assert (ahead == x["offset"]).all()
    assert x.groupby("sequence_id")["length"].sum().max() <= 2048


def test_pii(docs, none):
    out = pii.detect(docs).toPandas()
    assert len(out) == docs.count()
    assert out[out["doc_id"] == 6]["spans"].tolist() == ["email:5:12"] and out["n_email"].sum() == 1
    assert pii.detect(none).count() == 0
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.where("doc_id = 6").first().text == "mail [EMAIL] now"
    assert masked.where("doc_id = 6").first().n_chars == len("mail [EMAIL] now")
    assert masked.where("text IS NULL").count() == 1


def test_langid(docs, none):
    model = langid.train(docs)
    out = langid.predict(docs, model).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert set(out[out["doc_id"].isin([0, 1, 2])]["lang_pred"]) == {"und"}
    assert set(out[out["doc_id"] == 5]["lang_pred"]) <= {"en", "de"}
    empty = langid.train(none)
    assert set(langid.predict(docs, empty).toPandas()["lang_pred"]) == {"und"}
    assert langid.predict(none, model).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (5, 0, 0), (6, 0, 0), (7, 1, 0), (8, None, 0), (9, 0, 1), (9, 0, 1), (None, 1, 0), (1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == int(out["keep"].sum())
    assert quality.score(none, model).count() == 0
    for few in (quality.train(none, labels), quality.train(docs, labels.limit(0)), quality.train(docs, labels.where("quality = 1"))):
        even = quality.score(docs, few).toPandas()
        assert (even["score"] == 0.5).all() and even["keep"].all() and quality.keep_good(docs, few).count() == docs.count()


def test_fingerprint(docs, none):
    out = fingerprint.compare_versions(docs).toPandas()
    assert len(out) == docs.count()
    assert out["near_edited"].between(0, 1).all() and out["near_next"].between(0, 1).all()
    same = out[out["doc_id"].isin([8]) | ((out["doc_id"] == 4) & (out["n_chars"] == 13))]["fingerprint"]
    assert same.nunique() == 1 and len(same) == 4
    assert fingerprint.compare_versions(none).count() == 0
    assert fingerprint.compare_versions(docs.where("doc_id = 6")).first().near_next == 1.0


def test_chat(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", "a & b <c> \"d\" &lt;"), (1, 1, "assistant", ""), (2, 5, None, "x</turn>\n"), (None, 0, "assistant", LONG), (1, 0, "user", None)]
    rows = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(rows)
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", ""), ("user", ""), ("assistant", ""), ("assistant", turns[1][3])]
    assert back[1].loss_text == turns[1][3] and [(t.role, t.text) for t in back[2].turns] == [("", "x</turn>\n")]
    assert back[None].loss_text == LONG
    texts = chat.example_texts(made).where("conv_id = 1").collect()
    assert len(texts) == 2 and all(t.context.count("</turn>") == k + 2 for k, t in enumerate(sorted(texts, key=lambda t: t.start)))
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_html(spark):
    page = "<body><nav>menu</nav><article><h1>T &amp; x</h1><p>a\n b<p>c<script>'</p>'</script></article><div class='comments'>no</div></body>"
    rows = [(1, "http://a.b/1", page), (2, None, None), (3, "http://a.b/2", ""), (4, "x", "plain <text"), (1, "http://a.b/1", page), (5, "http://a.b/3", "<div><p>" + LONG)]
    out = html.extract_pages(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).toPandas()
    assert len(out) == 6
    got = dict(zip(out["page_id"], out["text"], strict=True))
    assert got[1] == "T & x\na b\nc" and got[2] == "" and got[3] == "" and got[4] == "plain <text" and got[5] == LONG.strip()
    assert (out["n_chars"] == out["text"].str.len()).all()


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(v) for v in rng.normal(size=8)]) for k in range(300)]
    rows += [(400, None), (500, [0.0] * 8), (600, [1.0] * 7 + [None]), (700, [float("nan")] * 8), (800, [1.0] * 7 + [float("inf")]), (900, [1.0] * 3), (100, rows[100][1]), (301, rows[100][1])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int")
    out = neighbours.search(table).toPandas()
    assert set(out["query_id"]) == {0, 100, 200} and (out.groupby("query_id").size() == 10).all()
    assert out[(out["query_id"] == 100) & (out["rank"] == 1)][["vec_id", "score"]].values.tolist() == [[301, 0.0]]
    assert neighbours.search(table.limit(0)).count() == 0
    few = neighbours.search(table.where("vec_id < 3"))
    assert sorted(few.toPandas()["vec_id"]) == [1, 2]


def test_mixing_targets_are_capped_and_reshared(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 50}
    docs = spark.createDataFrame([(k * 10_000 + j, " ".join("w" for _ in range(10)), s) for k, (s, n) in enumerate(sizes.items()) for j in range(n // 10)], "doc_id long, text string, source string")
    out = mixing.mix(docs).toPandas()
    target, weight = {}, dict(zip(sizes, (5, 2, 1, 5), strict=True))
    left, total = dict(weight), float(sum(sizes.values()))
    while left:  # share by weight, fix what is above its limit, share the rest anew
        shares = {s: total * w / sum(left.values()) for s, w in left.items()}
        above = [s for s in left if shares[s] > 3 * sizes[s]]
        if not above:
            target |= shares
            break
        for s in above:
            target[s] = 3.0 * sizes[s]
            total -= target[s]
            del left[s]
    assert out.groupby("source")["target"].first().to_dict() == pytest.approx(target)
    assert (abs(out.groupby("source")["taken"].sum() - pd.Series(target)) <= 1).all()
