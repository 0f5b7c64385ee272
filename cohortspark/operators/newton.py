"""Many multinomial heads of a few features at a time, by Newton steps.

Fits of several groups of rows, penalties, class weights and left-out folds are sought side by side: a round is one pass over the rows, in which
every task adds up loss, slope and curvature of all fits that still move; the driver holds a small matrix per fit. A fit without a
fold starts where that of all folds ended. The optimum is that of ``heads.fit_head``: features scaled by sample deviations of the fit's own
rows, a penalty of 1 / (C * n) on coefficients, classes weighed by inverse frequency if balanced. A feature that is constant there has no say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators import probs as P

#: Half the slope's square in the curvature, a step below which is a fit's last: what it leaves is of that number's square.
LAST = 1e-9
#: Rows whose curvature a task takes at a time.
ROWS = 8_192


class Linear:
    """A fitted head: ``weights`` (classes, features) and ``bias`` of the features as they stand."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, iterations: int):
        self.weights, self.bias, self.iterations = weights, bias, iterations

    def predict(self, rows: DataFrame, column: str = "p") -> DataFrame:
        x = [F.col("features")[j] for j in range(self.weights.shape[1])]
        z = [sum((F.lit(float(w)) * v for w, v in zip(own, x, strict=True)), F.lit(float(b))) for own, b in zip(self.weights, self.bias, strict=True)]
        return rows.withColumn(column, P.softmax(F.array(*z)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), d)


def _parts(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple]:
    """(group, fold, y, n, X with a column of ones) of each group in pieces of the batches (group, fold, y, n, features)."""
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        fold, y, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        x = np.concatenate([_matrix(batch.column(4), d), np.ones((batch.num_rows, 1))], 1)
        for c, name in enumerate(names.dictionary.to_pylist()):
            at = np.flatnonzero(code == c)
            for low in range(0, len(at), ROWS):
                k = at[low : low + ROWS]
                yield name, fold[k], y[k], n[k].astype(np.float64), x[k]


def _shares(x: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and their logs."""
    z = x @ theta.T
    z -= z.max(1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(1, keepdims=True))
    return np.exp(logs), logs


def _pass(rows: DataFrame, fits: list[tuple], scales: dict, d: int) -> dict[int, tuple]:
    """{fit: (loss, slope, curvature)} sums over its rows. ``fits`` are (number, group, left-out fold, weight by class, theta)."""
    by_group: dict = {}
    for f in fits:
        by_group.setdefault(f[1], []).append(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict = {}
        for name, fold, y, n, x in _parts(batches, d):
            middle, scale = scales[name]
            x[:, :d] = (x[:, :d] - middle) / scale
            for number, _, out, own, theta in by_group.get(name, ()):
                w = n * own[y] * (fold != out)
                p, logs = _shares(x, theta)
                k, e = theta.shape
                gap = p * w[:, None]
                curve = np.zeros((k, e, k, e))
                for c in range(k):
                    curve[c, :, c, :] = (x * gap[:, c, None]).T @ x
                spread = (np.sqrt(w)[:, None, None] * p[:, :, None] * x[:, None, :]).reshape(len(x), k * e)
                gap[np.arange(len(x)), y] -= w
                sums = (-(w * logs[np.arange(len(x)), y]).sum(), gap.T @ x, curve.reshape(k * e, k * e) - spread.T @ spread)
                told[number] = tuple(a + b for a, b in zip(told[number], sums, strict=True)) if number in told else sums
        if told:
            flat = [np.concatenate([[loss], g.ravel(), h.ravel()]).tolist() for loss, g, h in told.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.int32()), pa.array(flat, pa.list_(pa.float64()))], ["fit", "sums"])

    def add(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fit": x["fit"].iloc[:1], "sums": [np.sum(np.stack(x["sums"]), axis=0).tolist()]})

    kind = "fit int, sums array<double>"
    found = {}
    for r in rows.select("group", "fold", "y", "n", "features").mapInArrow(run, kind).groupBy("fit").applyInPandas(add, kind).collect():  # a row per fit
        s, e = np.array(r.sums), d + 1
        k = next(f[4] for f in fits if f[0] == r.fit).shape[0]
        found[r.fit] = (s[0], s[1 : 1 + k * e].reshape(k, e), s[1 + k * e :].reshape(k * e, k * e))
    return found


def _settle(rows: DataFrame, fits: dict[tuple, dict], scales: dict, d: int, rounds: int) -> None:
    """Newton steps, halved while they don't lower the loss. A fit holds theta, number, weights, penalty, total and free, and ends with its theta."""
    moving = dict(fits)
    for _ in range(rounds):
        if not moving:
            return
        told = _pass(rows, [(f["number"], key[0], key[3], f["own"], f["theta"]) for key, f in moving.items()], scales, d)
        for key, f in list(moving.items()):
            loss, slope, curve = told[f["number"]]
            f["rounds"] += 1
            theta, e = f["theta"], d + 1
            value = loss / f["total"] + 0.5 * (f["penalty"] * theta**2).sum()
            if "best" in f and value > f["best"] + 1e-12 * max(1.0, abs(f["best"])):
                f["step"] = f["step"] / 2
                if np.abs(f["step"]).max() < 1e-12:
                    f["theta"] = f["from"]
                    del moving[key]
                else:
                    f["theta"] = f["from"] + f["step"]
                continue
            g = (slope / f["total"] + f["penalty"] * theta).ravel()
            h = curve / f["total"] + np.diag(f["penalty"].ravel())
            free = np.tile(f["free"], len(theta))
            step = np.zeros(len(g))
            step[free] = -np.linalg.lstsq(h[np.ix_(free, free)], g[free], rcond=1e-13)[0]
            f.update({"best": value, "from": theta, "step": step.reshape(-1, e)})
            f["theta"] = theta + f["step"]
            if -g @ step / 2 < LAST:
                del moving[key]


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Equal rows as one with their number ``n``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def fit_heads(rows: DataFrame, classes: int, asked: list[tuple], rounds: int = 100) -> dict[tuple, Linear]:
    """A head for each of ``asked``, (group, C, balanced, left-out fold, -1 for none). Rows are written ones of (group, fold, y, n, features), n how many they stand for."""
    first = rows.select(F.size("features").alias("d")).first()
    if first is None:
        return {}
    d = first["d"]
    x = lambda j: F.col("features")[j]
    middles = {r["group"]: np.array([r[f"m{j}"] for j in range(d)]) for r in rows.groupBy("group").agg(*[(F.sum(F.col("n") * x(j)) / F.sum("n")).alias(f"m{j}") for j in range(d)]).collect()}
    at = F.create_map(*[F.lit(v) for g, m in middles.items() for v in (g, m.tolist())])[F.col("group")]
    off = lambda j: x(j) - F.col("_m")[j]
    stats = [a for j in range(d) for a in (F.sum(F.col("n") * off(j)).alias(f"s{j}"), F.sum(F.col("n") * off(j) * off(j)).alias(f"q{j}"), F.min(x(j)).alias(f"a{j}"), F.max(x(j)).alias(f"b{j}"))]
    told = rows.withColumn("_m", at).groupBy("group", "fold", "y").agg(F.sum("n").alias("n"), *stats).collect()  # a row per group, fold and class

    def seen(group: str, out: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by class, and sample deviations, 0 of what is constant."""
        own = [r for r in told if r["group"] == group and r["fold"] != out]
        n = np.zeros(classes)
        for r in own:
            n[r["y"]] += r["n"]
        s, q = (np.array([sum(r[f"{c}{j}"] for r in own) for j in range(d)], float) for c in "sq")
        var = np.maximum(q - s * s / max(n.sum(), 1), 0) / max(n.sum() - 1, 1)
        still = np.array([not own or min(r[f"a{j}"] for r in own) == max(r[f"b{j}"] for r in own) for j in range(d)])
        return n, np.where(still, 0.0, np.sqrt(var))

    scales = {}
    for g, m in middles.items():
        s = seen(g, -1)[1]
        scales[g] = (m, np.where(s > 0, s, 1.0))
    done: dict = {}
    keys = {(g, c, b, -1) for g, c, b, _ in asked} | set(asked)
    for whole in (True, False):
        fits = {}
        for number, key in enumerate(sorted(k for k in keys if (k[3] == -1) == whole)):
            g, c, balanced, out = key
            n, s = seen(g, out)
            own = np.where(n > 0, 1 / np.maximum(n, 1), 0.0) if balanced else np.ones(classes)
            theta = np.zeros((classes, d + 1))
            theta[:, d] = np.log1p(n * own / max((n * own).sum(), 1e-300) * n.sum())
            theta[:, d] -= theta[:, d].mean()
            if not whole:
                theta = done[g, c, balanced, -1]["theta"].copy()
            theta[:, :d][:, s == 0] = 0
            penalty = np.append((s / scales[g][1]) ** 2, 0.0) / (c * max(n.sum(), 1))
            fits[key] = {"number": number, "own": own, "theta": theta, "total": max((n * own).sum(), 1e-300), "penalty": np.tile(penalty, (classes, 1)), "free": np.append(s > 0, True), "rounds": 0}
        if any(not seen(k[0], k[3])[0].sum() for k in fits):
            raise ValueError("a fit has no rows")
        _settle(rows, fits, scales, d, rounds)
        done |= fits
    heads = {}
    for key, f in done.items():
        m, s = scales[key[0]]
        w = f["theta"][:, :d] / s
        bias = f["theta"][:, d] - w @ m
        heads[key] = Linear(w - w.mean(0), bias - bias.mean(), f["rounds"])
    return heads


def held_out_losses(rows: DataFrame, heads: dict[tuple, Linear], eps: float) -> dict[tuple, float]:
    """{(group, C, balanced): mean log loss} of rows under the heads that never saw their fold, in one pass."""
    own = {k: h for k, h in heads.items() if k[3] >= 0}
    if not own:
        return {}
    d = next(iter(own.values())).weights.shape[1]
    kinds = sorted({k[:3] for k in own})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(kinds), 2))
        for name, fold, y, n, x in _parts(batches, d):
            for (g, c, b, out), h in own.items():
                at = np.flatnonzero(fold == out) if g == name else ()
                if len(at):
                    p, _ = _shares(x[at], np.concatenate([h.weights, h.bias[:, None]], 1))
                    sums[kinds.index((g, c, b))] += (-(n[at] * np.log(np.maximum(p[np.arange(len(at)), y[at]], eps))).sum(), n[at].sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(kinds)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["kind", "loss", "n"])

    told = rows.select("group", "fold", "y", "n", "features").mapInArrow(run, "kind int, loss double, n double").groupBy("kind").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect()
    return {kinds[r.kind]: r.loss / r.n for r in told if r.n}
