"""Nearest rows of other splits by cosine in large tables: blocks that meet once, and in them buckets of random projections, probed from several sides.

Rows are dealt to a few blocks, and asking rows to parts; every part meets every block in a task of its own. So a vector is sent once to each block
and once to each part, however many tables and probes there are: what is shuffled grows with the rows, up to blocks of ``BLOCK`` numbers.

In a task, a table of projections gives every vector a bucket by the signs of its first projections. A row asks in its own bucket and in those that
differ in the signs nearest to zero. A bucket that holds too many rows is split by the signs of further projections, asked for in the same
way; what no projection splits is compared whole, so no row is left out of its bucket.
How many tables are used is measured: exact neighbours of a bounded sample of rows say how many it takes to reach the wanted recall. Where that many
tables would ask in more than ``SHARE`` of all rows, or never reach it, buckets spare no work, and a part is compared with the whole block.
Equal vectors of a split are one row with its first ``top_k`` ids, which are all that can be anyone's nearest.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.sources.tables import materialize

#: Rows of a bucket in the mean; rows whose exact neighbours are found to measure recall (in expectation), and neighbours that it takes to measure it; tables at most.
BUCKET, SAMPLE, MEASURED, TABLES = 256, 256, 50, 64
#: Share of all rows that a row may ask in by buckets; beyond it whole blocks are compared, which costs less for each row met.
SHARE = 1 / 8
#: Buckets that a row asks in per table; signs that split a crowded bucket at a time, and buckets asked in there; signs in all.
PROBES, MORE, MORE_PROBES, SIGNS = 16, 4, 6, 48
#: Numbers in the vectors of a block (64 MB as doubles); blocks and parts at least.
BLOCK, BLOCKS, PARTS = 8_000_000, 4, 16
#: Rows compared at a time, asking and asked; pairs whose cosines are taken at a time; pairs held before they are sorted out; cosines that may tie.
TALL, WIDE, PAIRS, HELD, TIE = 256, 4_096, 100_000, 2_000_000, 1e-9


def planes(tables: int, dims: int, seed: int) -> np.ndarray:
    """(tables, dims, SIGNS) directions; table t's don't depend on how many there are."""
    return np.stack([np.random.Generator(np.random.PCG64([seed, t])).standard_normal((dims, SIGNS)) for t in range(tables)])


def probes(margins: np.ndarray, first: int, bits: int, most: int) -> np.ndarray:
    """(rows, most) codes of signs first … first + bits to ask for: the row's own, then those it takes the least to cross over to. -1 fills up."""
    part = margins[:, first : first + bits]
    own = (part > 0) @ (1 << np.arange(bits))
    near = np.argsort(np.abs(part), axis=1)[:, : min(bits, 6)]
    sets = [s for k in range(near.shape[1] + 1) for s in itertools.combinations(range(near.shape[1]), k)]
    cost = np.stack([np.take_along_axis(np.abs(part), near[:, list(s)], 1).__pow__(2).sum(1) if s else np.zeros(len(part)) for s in sets], 1)
    flips = np.stack([(1 << near[:, list(s)]).sum(1) if s else np.zeros(len(part), np.int64) for s in sets], 1)
    order = np.argsort(cost, axis=1, kind="stable")[:, :most]
    codes = own[:, None] ^ np.take_along_axis(flips, order, 1)
    return np.concatenate([codes, np.full((len(part), most - codes.shape[1]), -1)], 1) if codes.shape[1] < most else codes


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(table: DataFrame, key: str) -> DataFrame:
    """(id, gid, split, v): rows that take part, with a digest of split and vector. Zero and broken vectors, and rows without key or split, take none."""
    vector = table.schema["features"].dataType
    kind = "array<float>" if isinstance(vector, T.ArrayType) and isinstance(vector.elementType, T.FloatType) else "array<double>"
    rows = table.select(F.col(key).alias("id"), "split", F.col("features").cast(kind).alias("v")).where(
        F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.col("split").isNotNull() & F.col("id").isNotNull()
    )
    return rows.withColumn("gid", F.md5(F.concat_ws("|", F.col("split").cast("string"), F.array_join(F.transform("v", lambda x: F.hex(F.xxhash64(x + F.lit(0.0)))), ""))))


def _distinct(table: DataFrame, key: str, top_k: int) -> DataFrame:
    """(gid, split, v, ids): one row for all rows of a split with one vector, with the first ``top_k`` ids."""
    # Many equal vectors are dealt to 64 parts before their first ids are sought.
    salted = _keyed(table, key).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    at = F.row_number().over(Window.partitionBy("gid", "salt").orderBy("id"))
    few = salted.select("gid", "id", "split", "v", at.alias("at"), "salt").where(F.col("at") <= top_k)
    return few.groupBy("gid").agg(F.first("split").alias("split"), F.first("v").alias("v"), F.slice(F.sort_array(F.collect_list("id")), 1, top_k).alias("ids"))


def tables_needed(rows: DataFrame, count: int, min_cosine: float, top_k: int, bits: int, wanted: float, seed: int, most: int = TABLES) -> tuple[int, float]:
    """(tables, recall): how many tables reach the wanted share of the exact neighbours of a sample of rows, ``most`` at most, and the share they reach.

    The share is 0 if the sample has fewer than ``MEASURED`` neighbours.
    """
    every = max(1, count // SAMPLE)
    asked = rows.where(F.pmod(F.xxhash64("gid"), F.lit(every)) == 0).select("gid", "split", "v").limit(4 * SAMPLE).toPandas()  # a bounded sample, for measuring only
    if not len(asked):
        return 0, 0.0
    queries, splits = _unit(np.stack(asked["v"]).astype(np.float64)), asked["split"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2))
            c = queries @ _unit(v).T
            c[(c < min_cosine) | (splits[:, None] == batch.column(1).to_numpy(zero_copy_only=False)[None, :])] = -2
            keep = np.argsort(-c, axis=1, kind="stable")[:, :top_k]
            q, k = np.nonzero(np.take_along_axis(c, keep, 1) > -2)
            at = keep[q, k]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c[q, at]), batch.column(2).take(pa.array(at))], ["q", "c", "v"])

    met = rows.select("gid", "split", "v").mapInArrow(run, f"q long, c double, v {rows.schema['v'].dataType.simpleString()}")
    best = met.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c")))).where(F.col("at") <= top_k).select("q", "v").toPandas()
    if len(best) < MEASURED:
        return 0, 0.0
    q, other = best["q"].to_numpy(), _unit(np.stack(best["v"]).astype(np.float64))
    found, need = np.zeros(len(q), bool), wanted * len(q)
    for t in range(most):
        p = planes(t + 1, queries.shape[1], seed)[t]
        own = probes(queries @ p, 0, bits, PROBES)[q]
        there = ((other @ p)[:, :bits] > 0) @ (1 << np.arange(bits))
        found |= (own == there[:, None]).any(1)
        if found.sum() >= need:
            break
    return t + 1, float(found.mean())


def hashed_neighbours(table: DataFrame, min_cosine: float, top_k: int, key: str = "vec_id", recall: float = 0.95, seed: int = 11) -> DataFrame:
    """(left_id, right_id, cosine): ``embedding_neighbours`` for large tables: cosines are exact, and ``recall`` of the pairs are found in the mean.

    A pair that is missed is one whose rows share no bucket; the number of tables is chosen by the recall on a sample (see ``tables_needed``), and
    where tables don't reach it with less work than comparing all, all are compared and none is missed.
    Zero vectors and those with null or non-finite parts take no part, nor do rows without a split; an empty table gives an empty one.
    """
    rows = materialize(_distinct(table, key, top_k).withColumn("num", F.monotonically_increasing_id()))
    count, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    bits = int(min(max(np.ceil(np.log2(max(count, 1) / BUCKET)), 1), SIGNS // 2))
    most = min(TABLES, int(SHARE * (1 << bits) / PROBES))
    tables, share = tables_needed(rows, count, min_cosine, top_k, bits, recall, seed, most) if most else (0, 0.0)
    near = _compared(rows, -(-count * dims // BLOCK), _meeting(min_cosine, top_k, tables if share >= recall else 0, bits, seed))
    return _of_ids(table, key, rows, near, top_k)


def exact_neighbours(table: DataFrame, min_cosine: float, top_k: int, key: str = "vec_id", blocks: int = BLOCKS, tall: int = TALL) -> DataFrame:
    """(left_id, right_id, cosine): the same with all rows compared: every part meets every block whole, ``tall`` rows at a time, and no pair is missed."""
    rows = materialize(_distinct(table, key, top_k).withColumn("num", F.monotonically_increasing_id()))
    count, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    near = _compared(rows, max(blocks, -(-count * dims // BLOCK)), _meeting(min_cosine, top_k, 0, 1, 0, tall))
    return _of_ids(table, key, rows, near, top_k)


def _of_ids(table: DataFrame, key: str, rows: DataFrame, near: DataFrame, top_k: int) -> DataFrame:
    """(left_id, right_id, cosine) of the rows of ``table`` from the near vectors found by tasks."""
    kind = table.schema[key].dataType.simpleString()
    # A row's nearest vectors, then the nearest ids among theirs: of vectors equally near, those with the smallest first ids hold the smallest.
    top = near.withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "first"))).where(F.col("at") <= top_k)
    own = rows.select(F.col("num").alias("b"), F.col("ids").alias("b_ids"))
    spread = top.select("a", "b", "c").join(own.hint("merge"), "b").select("a", "c", F.explode("b_ids").alias("b_id"))
    best = spread.withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b_id"))).where(F.col("at") <= top_k)
    every = _keyed(table, key).select(F.col("id").alias("a_id"), "gid").join(rows.select("gid", F.col("num").alias("a")).hint("merge"), "gid")
    pairs = every.select("a_id", "a").join(best.select("a", "b_id", "c").hint("merge"), "a")
    return pairs.groupBy(F.least("a_id", "b_id").cast(kind).alias("left_id"), F.greatest("a_id", "b_id").cast(kind).alias("right_id")).agg(F.max("c").alias("cosine"))


def _compared(rows: DataFrame, blocks: int, meet: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """(a, b, first, c): every part of the asking rows meets every block; a row goes to each block once and to each part once."""
    blocks, parts = max(blocks, BLOCKS), max(blocks, PARTS)
    block, part = (F.pmod(F.xxhash64("gid", F.lit(salt)), F.lit(n)).cast("int") for salt, n in ((0, blocks), (1, parts)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    what = ["num", F.col("ids")[0].alias("first"), F.xxhash64("split").alias("split"), "v"]
    asks, there = rows.select(every(blocks).alias("block"), part.alias("part"), *what), rows.select(block.alias("block"), every(parts).alias("part"), *what)
    there = there.toDF(*there.columns)  # both sides come from one table
    sides = [x.repartition(4 * blocks * parts, "block", "part").groupBy("block", "part") for x in (asks, there)]
    return sides[0].cogroup(sides[1]).applyInArrow(meet, f"a long, b long, first {rows.schema['ids'].dataType.elementType.simpleString()}, c double")


def _meeting(min_cosine: float, top_k: int, tables: int, bits: int, seed: int, tall: int = TALL) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a part and a block: each asking row's ``top_k`` nearest rows of other splits from ``min_cosine`` on, by buckets of ``tables`` tables or, with none, among all.

    Products in single precision, which are half as dear, tell which pairs may count; the cosines of these are taken anew in double precision.
    """

    def meet(asks: pa.Table, there: pa.Table) -> pa.Table:
        (u, su, a_num, _), (w, sw, b_num, first) = map(_side, (asks, there))
        tie = np.unique(first.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        u_low, w_low, slack = u.astype(np.float32), w.astype(np.float32), TIE + (u.shape[1] + 4) * 2.0**-23  # more than single precision may be off
        products, enough = np.empty(tall * WIDE, np.float32), np.empty(tall * WIDE, bool)
        least, found, held = np.full(len(u), min_cosine), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

        def settle() -> None:
            """Leaves of each row's pairs the ``top_k`` nearest, each once."""
            nonlocal found, held
            i, j, c = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((j, tie[j], -c, i))
            i, j, c = i[order], j[order], c[order]
            once = np.ones(len(i), bool)
            once[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            i, j, c = i[once], j[once], c[once]
            at = np.arange(len(i)) - np.searchsorted(i, i)
            least[i[at == top_k - 1]] = c[at == top_k - 1]
            found, held = [(i[at < top_k], j[at < top_k], c[at < top_k])], 0

        def compare(a: np.ndarray, b: np.ndarray) -> None:
            """Rows a ask among rows b, both by split; those of a row's own split are left out."""
            nonlocal held
            ours, theirs = su[a], sw[b]
            for split in np.unique(ours):
                mine = a[np.searchsorted(ours, split) : np.searchsorted(ours, split, "right")]
                for others in (b[: np.searchsorted(theirs, split)], b[np.searchsorted(theirs, split, "right") :]):
                    for y in range(0, len(others), WIDE):
                        across = others[y : y + WIDE]
                        wide = w_low[across].T
                        for x in range(0, len(mine), tall):
                            down = mine[x : x + tall]
                            c, near = (z[: len(down) * len(across)].reshape(len(down), -1) for z in (products, enough))
                            np.matmul(u_low[down], wide, out=c)
                            np.greater_equal(c, (least[down, None] - slack).astype(np.float32), out=near)
                            i, j = np.divmod(np.flatnonzero(near), len(across))
                            many = np.flatnonzero(np.bincount(i, minlength=len(down)) > top_k)
                            if len(many):
                                bound = least[down]
                                bound[many] = np.partition(c[many], -top_k, axis=1)[:, -top_k]
                                kept = c[i, j] >= bound[i] - 2 * slack
                                i, j = i[kept], j[kept]
                            for p in range(0, len(i), PAIRS):
                                k, m = down[i[p : p + PAIRS]], across[j[p : p + PAIRS]]
                                exact = np.einsum("ij,ij->i", u[k], w[m])  # equal vectors, equal cosines
                                kept = exact >= min_cosine
                                found.append((k[kept], m[kept], exact[kept]))
                                held += int(kept.sum())
                                if held > HELD:
                                    settle()

        def ask(plane: np.ndarray, a: np.ndarray, b: np.ndarray, at: int, wide: int, most: int) -> None:
            """Rows a ask for rows b in the buckets by signs at … at + wide."""
            asked, own = probes(u[a] @ plane, at, wide, most), probes(w[b] @ plane, at, wide, 1)[:, 0]
            k, n = np.nonzero(asked >= 0)
            asked = asked[k, n]
            order, theirs = np.argsort(asked, kind="stable"), np.argsort(own, kind="stable")  # a bucket's rows stay by split
            k, asked, b, own = k[order], asked[order], b[theirs], own[theirs]
            for code in np.intersect1d(asked, own):
                mine, others = (slice(np.searchsorted(x, code), np.searchsorted(x, code, "right")) for x in (asked, own))
                if others.stop - others.start > 4 * BUCKET and at + wide + MORE <= SIGNS:
                    ask(plane, a[k[mine]], b[others], at + wide, MORE, MORE_PROBES)
                else:
                    compare(a[k[mine]], b[others])

        if len(u) and len(w):
            if not tables:
                compare(np.arange(len(u)), np.arange(len(w)))
            for plane in planes(tables, u.shape[1], seed) if tables else ():
                ask(plane, np.arange(len(u)), np.arange(len(w)), 0, bits, PROBES)
        settle()
        i, j, c = found[0]
        return pa.table({"a": a_num[i], "b": b_num[j], "first": first.take(pa.array(j)), "c": c})

    return meet


def _side(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ChunkedArray]:
    """Unit vectors, splits, numbers and first ids of rows, by split."""
    split = rows["split"].to_numpy()
    order = np.argsort(split, kind="stable")
    v = _unit(_matrix(rows["v"].combine_chunks()))[order]
    return v, split[order], rows["num"].to_numpy()[order], rows["first"].take(pa.array(order))
