"""Quality by co-training: a text classifier and a metadata classifier teach each other, and both views are combined.

The text view sees how a text is written (pairs of character classes and some shares); the metadata view sees
what a page's record says about it (source, language, length, and its layout: lines, bytes to a line, words, bytes
to a word), none of its characters. Both are logistic models. In each round, each of them labels
the documents of an unlabelled pool that it is surest of, and these become training examples of the other. At the
end both are calibrated, combined, and every document is scored. Training uses bounded samples drawn by a hash of
the id; scoring covers all rows and whole texts.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.shingles import chunks, release, text_bytes, tidy, word_hashes, word_spans
from cohortspark.sources.tables import materialize, sized

#: Expected sizes of the labelled sample and of the unlabelled pool.
LABELLED, POOL = 3000, 2000
ROUNDS, SHARE = 3, 0.05
META = 512
META_COLUMNS = ("source", "lang", "n_chars")


def _classes() -> np.ndarray:
    """Class of each byte: letters by case, digits, spaces, line ends, each mark on its own, bytes of other letters together."""
    out = np.zeros(256, np.int64)
    out[97:123], out[65:91], out[48:58] = 1, 2, 3
    out[[32, 9]], out[[10, 13]] = 4, 5
    marks = [b for b in range(33, 127) if out[b] == 0]
    out[marks] = 6 + np.arange(len(marks))
    out[128:] = 6 + len(marks)
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1
N_TEXT = N_CLASSES * N_CLASSES + 8


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts), one row per text: square roots of the shares of class pairs, and shares of repeats, capitals, marks
    and the like; and its bytes, line ends and words."""
    raw, offsets = text_bytes(column)
    out, counts = np.zeros((len(column), N_TEXT), np.float32), np.zeros((len(column), 3), np.int64)
    for first, last in chunks(offsets):
        low = int(offsets[first])
        part, at = raw[low : int(offsets[last])], offsets[first : last + 1] - low
        begin, end = word_spans(part, at[:-1])
        words, cut = word_hashes(part, begin, end), np.searchsorted(begin, at)
        for d in range(last - first):
            c = CLASSES[part[at[d] : at[d + 1]]]
            row = out[first + d]
            if not len(c):
                row[-1] = 1
                continue
            n = len(c)
            pair = np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_CLASSES * N_CLASSES)
            row[: len(pair)] = np.sqrt(pair / n)
            w, size = words[cut[d] : cut[d + 1]], (end - begin)[cut[d] : cut[d + 1]]
            if len(w):
                row[-8] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
                row[-7] = len(np.unique(w)) / len(w)
                row[-6] = min(float(size.mean()) / 20, 3)
            kinds = np.bincount(c, minlength=N_CLASSES)
            row[-5], row[-4], row[-3] = kinds[2] / n, kinds[3] / n, kinds[6:-1].sum() / n
            row[-2] = min(np.log1p(n) / 12, 2)
            counts[first + d] = n, kinds[5], len(w)
    return out, counts


@functools.lru_cache(100_000)
def _cell(name: str, value: object) -> int:
    return int.from_bytes(hashlib.blake2b(f"{name}\1{value}".encode(), digest_size=4).digest(), "little") % META


def meta_features(columns: list[pa.Array | None], counts: np.ndarray) -> np.ndarray:
    """One row per document: hashed indicators of source and language, and of sizes and layout in steps of a part of an octave."""
    rows = len(counts)
    out = np.zeros((rows, META), np.float32)
    size, lines, words = counts.T.astype(float)
    steps = {
        "lines": np.floor(2 * np.log2(lines + 1)),
        "line": np.floor(4 * np.log2(size / (lines + 1) + 1)),
        "words": np.floor(2 * np.log2(words + 1)),
        "word": np.floor(8 * np.log2(size / np.maximum(words, 1) + 1)),
    }
    for name, step in steps.items():
        out[np.arange(rows), [_cell(name, v) for v in step.astype(int).tolist()]] = 1
    for name, column in zip(META_COLUMNS, columns, strict=True):
        if column is None:
            continue
        for k, value in enumerate(column.to_pylist()):
            if name == "n_chars" and value is not None:
                value = int(4 * np.log2(max(float(value), 0) + 1))
            out[k, _cell(name, value)] = 1
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    a: float = 1.0  # calibration: logit = a * z + b
    b: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * (((x - self.mean) / self.scale) @ self.weights + self.bias) + self.b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _largest(z: np.ndarray, each: np.ndarray) -> float:
    """A bound of the largest eigenvalue of z' diag(each) z, by power iteration."""
    v = np.ones(z.shape[1], z.dtype)
    for _ in range(12):
        v = z.T @ (each * (z @ (v / np.linalg.norm(v))))
    return 1.2 * float(np.linalg.norm(v))


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, steps: int = 150) -> Logistic:
    """Weighted so that both classes count alike; accelerated gradient descent on standardised columns. Constant columns get no weight."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    live = np.flatnonzero(x.max(axis=0) > x.min(axis=0))
    z = ((x[:, live] - mean[live]) / scale[live]).astype(np.float32)
    each = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1)).astype(np.float32)
    lip = 0.25 * (_largest(z, each) if len(live) else 0.0) + decay + 0.25
    w, b = np.zeros(len(live), np.float32), 0.0
    v, c = w, b
    for k in range(steps):
        g = (each * (_sigmoid(z @ v + c) - y)).astype(np.float32)
        w2, b2 = v - (z.T @ g + decay * v) / np.float32(lip), c - float(g.sum()) / lip
        t = k / (k + 3)
        v, c, w, b = w2 + np.float32(t) * (w2 - w), b2 + t * (b2 - b), w2, b2
    weights = np.zeros(x.shape[1])
    weights[live] = w
    return Logistic(mean, scale, weights, b)


def calibrate(model: Logistic, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on rows kept from training: Newton steps for slope and intercept."""
    z = model.logit(x)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
        h = p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        a, b = max(a - step[0], 0.0), b - step[1]
    model.a, model.b = model.a * a, model.b * a + b


@dataclass
class Model:
    text: Logistic
    meta: Logistic
    combine: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))  # of text logit, metadata logit, 1
    threshold: float = 0.5
    passed: dict = field(default_factory=lambda: {"text": 0, "meta": 0})  # pseudo-labels that each view gave the other

    @classmethod
    def neutral(cls) -> Model:
        """Scores all documents 0.5 and keeps them."""
        flat = lambda n: Logistic(np.zeros(n), np.ones(n), np.zeros(n), 0.0)
        return cls(flat(N_TEXT), flat(META))

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.text.logit(text), self.meta.logit(meta)
        return _sigmoid(np.stack([t, m, np.ones_like(t)], axis=1) @ self.combine), _sigmoid(t), _sigmoid(m)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, share: float = SHARE, lost: float = 0.005) -> Model:
    """``y`` is 1, 0 or -1 (unlabelled). Every fifth labelled row is kept for calibration, combination and the threshold.

    The threshold is 0.5 or less, as far as needed to reject at most ``lost`` of the kept good rows.
    """
    labelled = np.flatnonzero(y >= 0)
    kept, use = labelled[::5], np.setdiff1d(labelled, labelled[::5])
    pool = np.flatnonzero(y < 0)
    views = {"text": text, "meta": meta}
    taught = {v: (use.copy(), y[use].astype(float)) for v in views}
    models = {v: fit_logistic(x[use], y[use].astype(float)) for v, x in views.items()}
    passed = dict.fromkeys(views, 0)
    for _ in range(rounds):
        if not len(pool):
            break
        for v, other in (("text", "meta"), ("meta", "text")):
            z = models[v].logit(views[v][pool])
            order = np.argsort(z, kind="stable")
            n = max(1, int(len(pool) * share))
            rate = float(y[use].mean())  # as many of each kind as among the labelled
            low, high = order[: max(1, round(n * (1 - rate)))], order[::-1][: max(1, round(n * rate))]
            sure_low, sure_high = low[_sigmoid(z[low]) < 0.1], high[_sigmoid(z[high]) > 0.9]
            rows = pool[np.concatenate([sure_low, sure_high])]
            marks = np.concatenate([np.zeros(len(sure_low)), np.ones(len(sure_high))])
            seen = np.isin(rows, taught[other][0])
            passed[v] += int((~seen).sum())
            taught[other] = (np.concatenate([taught[other][0], rows[~seen]]), np.concatenate([taught[other][1], marks[~seen]]))
        models = {v: fit_logistic(x[taught[v][0]], taught[v][1]) for v, x in views.items()}
    for v, x in views.items():
        calibrate(models[v], x[kept], y[kept])
    model = Model(models["text"], models["meta"], passed=passed)
    both = np.stack([models["text"].logit(text[kept]), models["meta"].logit(meta[kept])], axis=1)
    joint = fit_logistic(both, y[kept].astype(float), decay=1e-2)
    calibrate(joint, both, y[kept])
    w = joint.a * joint.weights / joint.scale
    model.combine = np.array([*w, joint.a * (joint.bias - (joint.weights * joint.mean / joint.scale).sum()) + joint.b])
    p = model.score(text[kept], meta[kept])[0][y[kept] == 1]
    model.threshold = float(min(0.5, np.quantile(p, lost))) if len(p) else 0.0
    return model


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in META_COLUMNS if c in docs.columns]


def _batch_features(batch: pa.RecordBatch, text: int) -> tuple[np.ndarray, np.ndarray]:
    names = batch.schema.names
    columns = [batch.column(names.index(c)) if c in names else None for c in META_COLUMNS]
    features, counts = text_features(batch.column(text))
    return features, meta_features(columns, counts)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, meta = _batch_features(batch, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())],
            ["doc_id", "y", "text_view", "meta_view"],
        )


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Model:
    """Fit on ``docs`` and ``labels`` (doc_id, quality). Ids with two different labels are left out of training.

    Without labels of both kinds among ``docs`` (an empty table, for one) the model scores all 0.5 and keeps all. Null texts and
    metadata are values like others; of repeated doc_ids one row is drawn. Extra columns of both tables are ignored.
    """
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z").drop("z")
    marks = materialize(marks)
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    joined = materialize(ids.join(marks.hint("merge"), "doc_id", "left").withColumn("y", F.coalesce("y", F.lit(-1)).cast("int")))
    have = {r[0] >= 0: r[1] for r in joined.groupBy((F.col("y") >= 0).cast("int").alias("k")).count().withColumn("k", F.col("k") - 1).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000))
    most = F.when(F.col("y") >= 0, F.lit(1e6 * labelled / max(have.get(True, 1), 1))).otherwise(F.lit(1e6 * pool / max(have.get(False, 1), 1)))
    chosen = materialize(joined.where(draw < most))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (
        docs.select("doc_id", "text", *_columns(docs))
        .join(sized(chosen), "doc_id")
        .select("doc_id", "y", "text", *_columns(docs))
        .mapInArrow(_samples, f"doc_id {kind}, y int, text_view binary, meta_view binary")
        .toPandas()
        .drop_duplicates("doc_id")
        .sort_values("doc_id")
    )
    y = rows["y"].to_numpy()
    if not ((y == 0).any() and (y == 1).any()):
        return Model.neutral()
    view = lambda c, n: np.frombuffer(b"".join(rows[c]), np.float32).reshape(-1, n)
    order = np.argsort([hashlib.blake2b(str(i).encode(), digest_size=8).digest() for i in rows["doc_id"]], kind="stable")
    model = co_train(view("text_view", N_TEXT)[order], view("meta_view", META)[order], y[order])
    del rows, view
    release()
    return model


def _score(shared):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(0, batch.num_rows, 500):
                out.append(np.stack(shared.value.score(*_batch_features(batch.slice(k, 500), 1))))
            p = np.concatenate(out, axis=1) if out else np.zeros((3, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p[0]), pa.array(p[1]), pa.array(p[2]), pa.array(p[0] >= shared.value.threshold)],
                ["doc_id", "score", "text_score", "meta_score", "keep"],
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, score (0 to 1, higher is better), text_score, meta_score, keep.

    Null text counts as empty; source, lang and n_chars may be null or missing; other columns are ignored.
    Repeated rows are scored each on its own; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, text_score double, meta_score double, keep boolean"
    return docs.select("doc_id", "text", *_columns(docs)).mapInArrow(_score(shared), schema)


def _filter(shared, text: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                good = shared.value.score(*_batch_features(part, text))[0] >= shared.value.threshold
                yield part.filter(pa.array(good))

    return run


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model keeps.

    Null or empty text is scored like any other text; equal rows share their fate; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_filter(shared, docs.columns.index("text")), docs.schema)
