"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text is lowered; its subwords are runs of 3 and 4 bytes of words with borders marked, each hashed to one of
``BUCKETS`` embeddings. The mean embedding goes through a linear softmax. Both are trained together by stochastic
gradient descent in numpy on a bounded sample. Scores are calibrated by a temperature, and the score under which a
prediction should be rejected is set, on texts kept from training. Since the model is linear after the mean, the
trained embeddings and the softmax fold into one score table per bucket, which is what tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.llm.shingles import chunks, text_bytes
from cohortspark.sources.tables import materialize, sized

BUCKETS = 1 << 15
DIM = 16
#: Texts per language in the training sample, at most (in expectation).
PER_LANGUAGE = 500
UNDETERMINED = "und"
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_FIELDS = [(pa.int64(), "long"), (pa.int32(), "int")]


def subwords(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, buckets, ends): buckets of the subwords of rows [first, last), row by row up to ``ends``."""
    lowered = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    raw, offsets = text_bytes(lowered)
    for first, last in chunks(offsets, 1 << 19):
        low = int(offsets[first])
        letters = _LETTER[raw[low : int(offsets[last])]]
        ends = offsets[first + 1 : last + 1] - low
        # A border on each side of every document keeps subwords within it.
        spread = np.zeros(len(letters) + 4 * len(ends), np.uint32)
        spread[np.arange(len(letters)) + 4 * np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends)))) + 2] = letters
        borders = ends + 4 * np.arange(1, len(ends) + 1)
        grams = []
        n = len(spread) - 3
        if n <= 0:
            yield first, last, np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
            continue
        a, b, c, d = (spread[k : n + k] for k in range(4))
        three = (a << np.uint32(16)) | (b << np.uint32(8)) | c
        four = (three << np.uint32(8)) | d
        word = (b > 0) & ((a > 0) | (c > 0))  # the middle is a letter and one side too
        for x, live, salt in ((three, word, 0x9E3779B1), (four, word & (c > 0), 0x85EBCA77)):
            at = np.flatnonzero(live)
            grams.append((at, ((x[at] * np.uint32(salt)) >> np.uint32(17)).astype(np.int64)))
        at = np.concatenate([g[0] for g in grams])
        order = np.argsort(at, kind="stable")
        at, buckets = at[order], np.concatenate([g[1] for g in grams])[order]
        yield first, last, buckets, np.searchsorted(at, borders - 2)


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(column.cast(pa.large_string()).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, part, buckets, counts): the whole text (part 0) and up to two short stretches of it, which teach short texts."""
    for batch in batches:
        keys, texts, parts = [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = (text or "").split()
            stretches = [text or ""]
            if len(words) > 16:
                stretches += [" ".join(words[len(words) // 3 :][:5]), " ".join(words[len(words) // 2 :][:9])]
            for k, x in enumerate(stretches):
                keys.append(key)
                parts.append(k)
                texts.append(x)
        out_b, out_n = [None] * len(texts), [None] * len(texts)
        for first, _, buckets, ends in subwords(pa.array(texts, pa.large_string())):
            at = 0
            for k, end in enumerate(ends):
                out_b[first + k], out_n[first + k] = np.unique(buckets[at:end], return_counts=True)
                at = end
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, batch.column(0).type), pa.array(parts, pa.int32()), pa.array([x.astype(np.int32) for x in out_b], pa.list_(pa.int32())), pa.array([x.astype(np.int32) for x in out_n], pa.list_(pa.int32()))],
            ["key", "part", "buckets", "counts"],
        )


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): the softmax input of a text of one subword
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, buckets: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros((1, self.table.shape[1])), np.cumsum(self.table[buckets], axis=0, dtype=np.float64)))
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1)[:, None] + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray, bool]], epochs: int = 12, rate: float = 1.0, batch: int = 16, seed: int = 3) -> Model:
    """SGD on samples (language, buckets, counts, kept for calibration)."""
    languages = sorted({s[0] for s in samples})
    rng = np.random.Generator(np.random.PCG64(seed))
    code = {x: k for k, x in enumerate(languages)}
    use = [s for s in samples if not s[3] and len(s[1])] or [s for s in samples if len(s[1])]
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(use))
        for k in range(0, len(order), batch):
            some = [use[j] for j in order[k : k + batch]]
            seen, inverse = np.unique(np.concatenate([s[1] for s in some]), return_inverse=True)
            share = np.zeros((len(some), len(seen)), np.float32)
            rows = np.repeat(np.arange(len(some)), [len(s[1]) for s in some])
            share[rows, inverse] = np.concatenate([s[2] / s[2].sum() for s in some])
            mean = share @ embed[seen]
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), [code[s[0]] for s in some]] -= 1
            p /= len(some)
            grad = share.T @ (p @ soft.T)
            soft -= step * (mean.T @ p)
            bias -= step * 0.1 * p.sum(axis=0)
            embed[seen] -= 20 * step * grad
    model = Model(languages, (embed @ soft).astype(np.float32), bias.astype(np.float64))
    kept = [s for s in samples if s[3] and len(s[1])] or use
    if kept:
        z = np.array([(model.table[s[1]] * s[2][:, None]).sum(axis=0) / s[2].sum() for s in kept]) + model.bias
        y = np.array([code[s[0]] for s in kept])

        def loss(t: float) -> float:
            w = z / t
            top = w.max(axis=1)
            return float((top + np.log(np.exp(w - top[:, None]).sum(axis=1)) - w[np.arange(len(y)), y]).mean())

        model.temperature = float(min(np.exp(np.linspace(-2.5, 2.5, 101)), key=loss))
        p = model.scores(z)
        right, best = p.argmax(axis=1) == y, p.max(axis=1)
        order = np.argsort(-best)
        precise = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.98)
        model.reject_below = float(best[order][precise[-1]]) if len(precise) else 1.0
    return model


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on (doc_id, text, lang): a sample of ``per_language`` texts a language, drawn by a hash of the id; a fifth calibrates."""
    known = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    quota = materialize(known.groupBy("lang").count())
    chance = F.lit(float(per_language) * 1_000_000) / F.col("count")
    chosen = known.select("doc_id", "lang").join(sized(quota), "lang").where(draw < chance).select("doc_id", "lang").dropDuplicates(["doc_id"])
    chosen = materialize(chosen)
    texts = labelled.select("doc_id", "text").join(sized(chosen), "doc_id")
    key = F.struct("doc_id", "lang").alias("key")
    kind = T.StructType([T.StructField("doc_id", labelled.schema["doc_id"].dataType), T.StructField("lang", T.StringType())]).simpleString()
    rows = texts.select(key, "text").mapInArrow(_histograms, f"key {kind}, part int, buckets array<int>, counts array<int>").collect()
    rows.sort(key=lambda r: (r.key.lang, r.key.doc_id, r.part))
    of = {d: k for k, d in enumerate(sorted({r.key.doc_id for r in rows}))}
    samples = [(r.key.lang, np.array(r.buckets, np.int64), np.array(r.counts, np.float32), of[r.key.doc_id] % 5 == 0) for r in rows]
    return fit(samples) if samples else Model([UNDETERMINED], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), reject_below=1.0)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            text = batch.column(1)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for first, last, buckets, ends in subwords(text):
                p = model.scores(model.logits(buckets, ends))
                best[first:last], score[first:last] = p.argmax(axis=1), p.max(axis=1)
            none = ~has_letter(text)
            best[none], score[none] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(none | (score < model.reject_below))],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score, rejected. Null or letterless text: und, 0.0, true.

    The whole text counts. Repeated rows are scored each on its own; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == remainder, F.lit(False))
