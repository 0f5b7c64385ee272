"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are rotated at random, so that any few coordinates tell about the whole distance, and dealt to the list of
their nearest centroid; the index keeps the rotated ones as columns, each a block of coordinates. A query looks through
the lists whose centroids are nearest to it. Within a list, partial distances grow block by block, and after each block
a test drops candidates whose distance is too large to come among the best, with high probability. What is left is
measured exactly on the original vectors.

The index is fitted on a bounded sample and holds every row; lists grow in number with the square root of the rows. How many lists to look through is set on the sample so that
``recall`` of true neighbours lie in them. Lists and the queries of a list are dealt in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.sources.tables import materialize

K = 10
#: Rows of the sample that fits the index (or EACH for a list, if these are more), lists at most, and rows of a list (or
#: queries of it) in one task.
SAMPLE, EACH, LISTS, PART, QUERIES = 12_000, 8, 8192, 4096, 1024
#: Coordinates a block has at least, blocks at most, and how many standard deviations a partial distance must lie over the bound to be dropped.
BLOCK, BLOCKS, SURE = 8, 16, 2.1
#: Rows of the sample that give a query its first bound: a thousand, a tenth of the table at most.
BOUNDING = 1000
RECALL = 0.98


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    ids: np.ndarray  # of sample rows, which give each query a first bound
    sample: np.ndarray


def valid_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vector as bytes of doubles) of rows whose vector is there, isn't zero and has finite components only, all of one length.

    The length is the commonest one, the smaller of equally common ones.
    """
    v = F.col("embedding")
    fine = table.where(
        v.isNotNull()
        & F.col("vec_id").isNotNull()
        & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    ).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    top = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size("v") == (top[0] if top else 0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)[None, :], 0)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([_squared(x[k : k + 2000], centroids).argmin(axis=1) for k in range(0, len(x), 2000)] or [np.zeros(0, np.int64)])


def list_count(rows: int) -> int:
    return int(max(1, min(LISTS, np.sqrt(rows))))


def borders(dim: int) -> list[int]:
    """Where the blocks of coordinates begin, and ``dim``."""
    width = max(BLOCK, -(-dim // BLOCKS))
    return [*range(0, dim, width), dim]


def fit(ids: np.ndarray, sample: np.ndarray, rows: int, recall: float = RECALL, seed: int = 9) -> Index:
    rng = np.random.Generator(np.random.PCG64(seed))
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    lists = min(list_count(rows), len(sample) // EACH + 1)
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(8):
        own = _nearest(sample, centroids)
        n = np.bincount(own, minlength=lists)
        sums = np.stack([np.bincount(own, sample[:, d], lists) for d in range(dim)], axis=1)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    probes = lists
    if len(sample) > 10 * K:
        own = _nearest(sample, centroids)
        q = rng.permutation(len(sample))[:200]
        d = _squared(sample[q], sample)
        d[np.arange(len(q)), q] = np.inf
        near = np.argpartition(d, K, axis=1)[:, :K]
        rank = np.argsort(np.argsort(_squared(sample[q], centroids), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(rank, own[near], axis=1).reshape(-1))
        probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    some = rng.permutation(len(sample))[: min(BOUNDING, rows // 10)]
    return Index(rotation, centroids, probes, ids[some], sample[some])


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _rows(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    raw = np.ascontiguousarray(x)
    at = np.arange(len(raw) + 1, dtype=np.int32) * (raw.shape[1] * raw.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(at), pa.py_buffer(raw)])


def _assign(shared):
    """(vec_id, v) to (list, vec_id, v as bytes, blocks of the rotated v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                own, rotated, at = _nearest(x, index.centroids), (x @ index.rotation).astype(np.float32), borders(x.shape[1])
                blocks = [_rows(rotated[:, a:b]) for a, b in zip(at, at[1:])]
                names = ["list", "vec_id", "v", *(f"b{k}" for k in range(len(blocks)))]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0), _rows(x), *blocks], names)

    return run


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _first_bounds(shared):
    """Queries to (query_id, v, bound, lists, near): the K nearest rows of the sample, their largest distance, and the lists to look through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts = shared.value
        for batch in batches:
            ids = batch.column(1).to_numpy()
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(len(ids), -1)
            bounds, lists, near = [], [], []
            for i, v in zip(ids.tolist(), x, strict=True):
                d = exact(v, index.sample)
                d[index.ids == i] = np.inf
                best = np.lexsort((index.ids, d))[:K]
                best = best[np.isfinite(d[best])]
                bounds.append(float(d[best[-1]]) if len(best) == K else float("inf"))
                near.append([{"vec_id": int(index.ids[b]), "score": float(d[b])} for b in best])
                order = np.argsort(_squared(v[None], index.centroids)[0], kind="stable")
                n = max(index.probes, int(np.searchsorted(np.cumsum(counts[order]), 50 * K)) + 1)
                lists.append([int(k) for k in order[:n] if counts[k]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids), batch.column(2), pa.array(bounds, pa.float64()), pa.array(lists, pa.list_(pa.int32())),
                    pa.array(near, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))),
                ],
                ["query_id", "v", "bound", "lists", "near"],
            )

    return run


def scan(rotated_query: np.ndarray, blocks: list[np.ndarray], bound: float) -> np.ndarray:
    """Rows that may lie within ``bound``: partial distances by blocks of rotated coordinates, dropped once they are surely too large.

    ``blocks`` holds the rows' coordinates in single precision, which the last test allows for.
    """
    dim = len(rotated_query)
    alive, partial, first = np.arange(len(blocks[0])), np.zeros(len(blocks[0])), 0
    for block in blocks:
        last = first + block.shape[1]
        partial = partial + ((block[alive] - rotated_query[first:last]) ** 2).sum(axis=1)
        most = bound * bound * (last / dim) * (1 + SURE / np.sqrt(last)) ** 2 if last < dim else bound * bound * (1 + 1e-4)
        keep = partial <= most
        alive, partial, first = alive[keep], partial[keep], last
        if not len(alive):
            break
    return alive


def _search(shared):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(rows):
            q, x = (np.frombuffer(b"".join(f["v"]), np.float64).reshape(len(f), -1) for f in (queries, rows))
            ids, rq = rows["vec_id"].to_numpy(), q @ shared.value[0].rotation
            blocks = [np.frombuffer(b"".join(rows[f"b{k}"]), np.float32).reshape(len(rows), -1) for k in range(len(borders(x.shape[1])) - 1)]
            for k, (i, bound) in enumerate(zip(queries["query_id"].to_numpy(), queries["bound"].to_numpy(), strict=True)):
                found = scan(rq[k], blocks, bound)
                found = found[ids[found] != i]
                d = exact(q[k], x[found])
                best = np.lexsort((ids[found], d))[:K]
                out += [(i, ids[found[b]], d[b]) for b in best if d[b] <= bound]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def search(table: DataFrame, every: int = 100, sample_rows: int = SAMPLE) -> DataFrame:
    """The K nearest rows found for each row of ``table`` (vec_id long, embedding) whose vec_id is divisible by ``every``.

    (query_id, rank from 1, vec_id, score): Euclidean distance in double precision, nearest first, ties to the smaller
    vec_id; all candidates if there are fewer than K. Rows that ``valid_vectors`` leaves out take no part. Of rows with the same
    vec_id none is a neighbour of another; a query that stands in several rows is one query (its least vector). An
    empty table gives an empty result; other columns are ignored. ``sample_rows`` bounds what the index is fitted on.
    """
    spark = table.sparkSession
    vectors = materialize(valid_vectors(table.select("vec_id", "embedding")))
    rows = vectors.count()
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1_000_000)) < F.lit(1e6 * max(sample_rows, EACH * list_count(rows)) / max(rows, 1))).collect()
    chosen = sorted((r.vec_id, tuple(r.v)) for r in chosen)  # about so many rows, EACH * LISTS at most
    dim = len(chosen[0][1]) if chosen else 1
    sample = np.array([c[1] for c in chosen], np.float64).reshape(-1, dim)
    index = fit(np.array([c[0] for c in chosen], np.int64), sample, rows) if chosen else Index(np.eye(1), np.zeros((1, 1)), 1, np.zeros(0, np.int64), np.zeros((0, 1)))
    held = spark.sparkContext.broadcast(index)
    blocks = [f"b{k}" for k in range(len(borders(dim)) - 1)]
    listed = materialize(vectors.mapInArrow(_assign(held), ", ".join(["list int, vec_id long, v binary", *(f"{b} binary" for b in blocks)])))
    counts = np.zeros(len(index.centroids), np.int64)
    for k, n in listed.groupBy("list").count().collect():  # one row per list
        counts[k] = n
    shared = spark.sparkContext.broadcast((index, counts))
    asked = listed.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select(F.lit(0).alias("list"), "vec_id", "v")
    queries = materialize(asked.mapInArrow(_first_bounds(shared), "query_id long, v binary, bound double, lists array<int>, near array<struct<vec_id:bigint,score:double>>"))
    looks = materialize(queries.select(F.explode("lists").alias("list"), "query_id").groupBy("list").count().select("list", F.col("count").alias("looks")))
    sizes = spark.createDataFrame([(int(k), int(n)) for k, n in enumerate(counts)], "list int, rows long")
    deal = materialize(
        sizes.join(F.broadcast(looks), "list").select("list", F.ceil(F.col("rows") / PART).cast("int").alias("parts"), F.ceil(F.col("looks") / QUERIES).cast("int").alias("shares"))
    )
    deal = F.broadcast(deal)  # one row per list, LISTS at most
    to = lambda n, c: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.select("query_id", "v", "bound", F.explode("lists").alias("list")).join(deal, "list").select("list", all_of("parts").alias("part"), to("shares", "query_id").alias("share"), "query_id", "v", "bound")
    right = listed.join(deal, "list").select("list", to("parts", "vec_id").alias("part"), all_of("shares").alias("share"), "vec_id", "v", *blocks)
    key = ["list", "part", "share"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(shared), "query_id long, vec_id long, score double")
    first = queries.select("query_id", F.explode("near").alias("x")).select("query_id", "x.*")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    merged = found.unionByName(first).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
