"""Thousands of resampling draws at once: arrays over draws are summed, so a row for each (group, draw) never exists.

Every unit (a group, or a cell of equal rows) has counts in a few cells and a weight in each draw. A task makes the weights of its units
as a matrix, multiplies it by their counts, and hands on one array over draws per cell, in blocks; arrays of tasks are added up. What
is left has a row per cell and block of draws, however many units there are. All models of a table share a draw's weights, so
any of their differences can be taken draw by draw.

Weights come from numbers that are hashes of (seed, draw, unit), so they don't depend on partitioning; or they are
multinomial, with exactly as many picks in a draw as there are units: picks are dealt to halves of the buckets of units, to halves of
these and so on, down to a bucket, and inside it to its units. Every split is drawn from a generator seeded by its place in the tree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.sources.tables import materialize

#: Draws of a block, rows of counts that a task turns into a matrix at a time, units of a multinomial bucket.
BLOCK, ROWS, BUCKET = 256, 100_000, 1_024
#: Upper ends of the 32-bit numbers that stand for Poisson(1) weights 0, 1, 2, …
POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(8)]
#: Multipliers and shifts of a 32-bit mix whose products fit in 63 bits, so that SQL can repeat it.
MIX = ((15, 0x2C1B3C6D), (12, 0x297A2D39), (15, 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers whose bits depend on all."""
    for shift, factor in MIX:
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x


def mixed_numbers(seed: object, draws: np.ndarray, keys: list[str]) -> np.ndarray:
    """A 32-bit number for each key (row) and draw (column), from 64 bits of the key's MD5."""
    digest = np.frombuffer(b"".join(hashlib.md5(k.encode()).digest()[:8] for k in keys), ">u4").astype(np.uint32).reshape(-1, 2)
    start = np.uint32(int(hashlib.md5(str(seed).encode()).hexdigest()[:8], 16))
    own = mix(mix(np.array([start], np.uint32)) ^ draws.astype(np.uint32))
    return mix(mix(own[None, :] ^ digest[:, :1]) ^ digest[:, 1:])


def md5_numbers(seed: object, draws: np.ndarray, keys: list[str]) -> np.ndarray:
    """The numbers of ``resample.uniform``: the first 32 bits of md5("seed|draw|key")."""
    heads = [hashlib.md5(f"{seed}|{d}|".encode()) for d in draws.tolist()]
    out = []
    for k in (key.encode() for key in keys):
        for head in heads:
            own = head.copy()
            own.update(k)
            out.append(own.digest()[:4])
    return np.frombuffer(b"".join(out), ">u4").astype(np.uint32).reshape(len(keys), len(draws))


def poisson(numbers: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(POISSON, np.uint64), numbers, "right")


def coin(numbers: np.ndarray) -> np.ndarray:
    return numbers & np.uint32(1)


Weigh = Callable[[np.ndarray, list[str]], np.ndarray]


def hashed(numbers: Callable, kind: Callable, seed: object) -> Weigh:
    """Weights (draws, keys) -> matrix, keys in rows. Draw -1 is the table as it is: all weights are 1."""

    def weigh(draws: np.ndarray, keys: list[str]) -> np.ndarray:
        out = np.ones((len(keys), len(draws)))
        real = draws >= 0
        out[:, real] = kind(numbers(seed, draws[real], keys))
        return out

    return weigh


class _Sums:
    """Arrays over draws of the cells seen so far."""

    def __init__(self, draws: np.ndarray):
        self.draws, self.place, self.total = draws, {}, np.zeros((0, len(draws)))

    def add(self, cells: list[tuple], of: np.ndarray, unit: np.ndarray, n: np.ndarray, weights: Callable[[int, int], np.ndarray], units: int) -> None:
        """Counts ``n`` of rows (cell ``of``, ``unit``), whose units weigh ``weights(first, last)`` in a block of draws."""
        new = [c for c in cells if c not in self.place]
        if new:
            self.place |= {c: len(self.place) + k for k, c in enumerate(new)}
            self.total = np.concatenate([self.total, np.zeros((len(new), len(self.draws)))])
        at = np.array([self.place[c] for c in cells])
        counts = np.zeros((len(cells), units))
        np.add.at(counts, (of, unit), n)
        for low in range(0, len(self.draws), BLOCK):
            self.total[at, low : low + BLOCK] += counts @ weights(low, low + BLOCK)

    def batches(self, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(self.draws), BLOCK):
            values = np.rint(self.total[:, low : low + BLOCK]).astype(np.int64)
            wide = values.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * wide), pa.array(values.ravel()))
            keys = list(zip(*self.place, strict=True)) if self.place else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*[pa.array(list(k), t) for k, t in zip(keys, types, strict=True)], pa.array([low // BLOCK] * len(values), pa.int32()), lists], [*names, "block", "v"])


def _coded(frame: pd.DataFrame, names: list[str]) -> tuple[list[tuple], np.ndarray]:
    """(distinct tuples of the columns ``names``, each row's place among them)."""
    of = frame.groupby(names, sort=False, dropna=False).ngroup().to_numpy()
    first = pd.Series(of).drop_duplicates().index
    clean = frame[names].iloc[first].astype(object).where(frame[names].iloc[first].notna(), None)
    return list(clean.itertuples(index=False, name=None)), of


def _frames(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for b in batches:
        held.append(b.to_pandas())
        size += b.num_rows
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def _types(df: DataFrame, names: list[str]) -> tuple[str, list[pa.DataType]]:
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.ShortType: pa.int16(), T.ByteType: pa.int8(), T.BooleanType: pa.bool_()}
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names), [kinds[type(df.schema[n].dataType)] for n in names]


def _added(arrays: DataFrame, names: list[str]) -> DataFrame:
    """Sums of the arrays of tasks by cell and block, one row at a time."""
    schema, types = _types(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, done = None, None, []

        def told() -> pa.RecordBatch:
            keys = list(zip(*[k for k, _ in done], strict=True))
            return pa.RecordBatch.from_arrays([*[pa.array(list(k), t) for k, t in zip(keys, [*types, pa.int32()], strict=True)], pa.array([v for _, v in done], pa.list_(pa.int64()))], [*names, "block", "v"])

        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(names) + 1)], strict=True))
            for k, key in enumerate(keys):
                values = batch.column(len(names) + 1)[k].values.to_numpy()
                if key == now:
                    total = total + values
                else:
                    if now is not None:
                        done.append((now, total))
                    now, total = key, values
            if len(done) > 500:
                yield told()
                done = []
        if now is not None:
            done.append((now, total))
            yield told()

    dealt = arrays.repartition(*names, "block").sortWithinPartitions(*names, "block")
    return dealt.select(*names, "block", "v").mapInArrow(run, f"{schema}, block int, v array<bigint>")


def vector_sums(rows: DataFrame, unit: str, cell: list[str], draws: int, weigh: Weigh) -> DataFrame:
    """(cell, block, v): per cell and block of draws the sums of n * weight over ``rows`` (unit, cell, n); draw -1 comes first.

    A null unit weighs 1 in all draws. A unit's rows may stand anywhere; they are dealt by unit, so its weights are made a few times at most.
    """
    schema, types = _types(rows, cell)
    every = np.arange(-1, draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(every)
        for f in _frames(batches, ROWS):
            cells, of = _coded(f, cell)
            units, place = _coded(f, ["_unit"])
            for low in range(0, len(units), BUCKET):
                mine = (place >= low) & (place < low + BUCKET)
                keys = [u[0] for u in units[low : low + BUCKET]]
                named = [k for k in keys if k is not None]
                has = np.array([k is not None for k in keys])

                def weights(a: int, b: int, has=has, named=named) -> np.ndarray:
                    out = np.ones((len(has), len(every[a:b])))
                    out[has] = weigh(every[a:b], named)
                    return out

                sums.add(cells, of[mine], place[mine] - low, f["n"].to_numpy()[mine], weights, len(keys))
        yield from sums.batches(cell, types)

    dealt = rows.select(F.col(unit).cast("string").alias("_unit"), *cell, "n").repartition("_unit").sortWithinPartitions("_unit")
    return _added(dealt.mapInArrow(run, f"{schema}, block int, v array<bigint>"), cell)


def multinomial_sums(rows: DataFrame, unit: list[str], cell: list[str], draws: int, seed: int, stratum: str | None = None, mass: str | None = None) -> DataFrame:
    """``vector_sums`` with multinomial weights: in every draw the units of a stratum are picked, with return, as often as their masses add up to.

    A unit is picked in proportion to its ``mass`` (by default 1). Rows (unit, stratum, mass, cell, n) hold counts of one pick of the unit;
    its mass and stratum are the same in all of them. Units lie in buckets by hash, some ``BUCKET`` in each; a bucket is one task's, and tasks know the
    buckets' masses, a few bytes per ``BUCKET`` units.
    """
    schema, types = _types(rows, cell)
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    key = F.sha2(F.to_json(F.struct(*[F.col(u).cast("string").alias(f"u{k}") for k, u in enumerate(unit)])), 256)
    keyed = materialize(rows.select(s.alias("_s"), key.alias("_key"), (F.col(mass) if mass else F.lit(1)).cast("bigint").alias("_mass"), *cell, "n"))
    units = keyed.groupBy("_s", "_key").agg(F.first("_mass").alias("_mass"))
    count = units.count()
    buckets = 1 << max(0, math.ceil(math.log2(max(count, 1) / BUCKET)))
    bucket = (F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") % buckets).cast("int")
    masses = units.groupBy("_s", bucket.alias("b")).agg(F.sum("_mass").alias("m")).collect()
    edges: dict[str, np.ndarray] = {x: np.zeros(buckets + 1, np.int64) for x in {r["_s"] for r in masses}}
    for r in masses:
        edges[r["_s"]][r["b"] + 1] = r["m"]
    edges = {x: np.cumsum(v) for x, v in edges.items()}
    every = np.arange(-1, draws)

    def rng(x: str, place: int) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64([seed, int(hashlib.md5(x.encode()).hexdigest()[:8], 16), place]))

    def picks_of(x: str, b: int) -> np.ndarray:
        """Picks of each draw that fall in bucket ``b``, halving the buckets round it from the root of the tree down."""
        edge, low, high, place = edges[x], 0, buckets, 1
        picks = np.full(draws, edge[-1])
        while high - low > 1:
            middle, total = (low + high) // 2, edge[high] - edge[low]
            left = rng(x, place).binomial(picks, (edge[middle] - edge[low]) / total if total else 0.0)
            picks, low, high, place = (left, low, middle, 2 * place) if b < middle else (picks - left, middle, high, 2 * place + 1)
        return picks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(every)

        def solve(f: pd.DataFrame) -> None:
            x, b = f["_s"].iloc[0], int(f["_b"].iloc[0])
            units, place = np.unique(f["_key"].to_numpy(), return_inverse=True)
            own = np.zeros(len(units))
            own[place] = f["_mass"]
            weights = np.ones((len(units), draws + 1))
            weights[:, 1:] = rng(x, 2 * buckets + b).multinomial(picks_of(x, b), own / own.sum()).T
            weights[:, 0] = own
            cells, of = _coded(f, cell)
            sums.add(cells, of, place, f["n"].to_numpy(), lambda low, high: weights[:, low:high], len(units))

        held = None
        for batch in batches:
            f = batch.to_pandas()
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            change = np.flatnonzero((f["_s"].to_numpy()[1:] != f["_s"].to_numpy()[:-1]) | (f["_b"].to_numpy()[1:] != f["_b"].to_numpy()[:-1])) + 1
            for low, high in zip([0, *change[:-1].tolist()], change.tolist(), strict=False):
                solve(f.iloc[low:high])
            held = f.iloc[change[-1] :] if len(change) else f
        if held is not None and len(held):
            solve(held)
        yield from sums.batches(cell, types)

    dealt = keyed.withColumn("_b", bucket).repartition("_s", "_b").sortWithinPartitions("_s", "_b", "_key")
    return _added(dealt.select("_s", "_b", "_key", "_mass", *cell, "n").mapInArrow(run, f"{schema}, block int, v array<bigint>"), cell)


def ranked_areas(counts: DataFrame, draws: int, weigh: Weigh) -> DataFrame:
    """(draw, auroc) of (g, score, pos, neg) under weights of the units ``g``; null where a draw lacks hits or misses."""
    every = np.arange(-1, draws)
    chunk = max(100, 4_000_000 // len(every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(len(every))
        area, all_pos, all_neg, open_pos, open_neg, open_score, least = zero, zero, zero, zero, zero, None, None

        def close(pos: np.ndarray, neg: np.ndarray) -> None:
            """Adds scores in order (rows) whose weights of hits and misses are known."""
            nonlocal area, all_pos, all_neg
            below = np.cumsum(neg, axis=0) - neg + all_neg
            area = area + (pos * (below + neg / 2)).sum(0)
            all_pos, all_neg = all_pos + pos.sum(0), all_neg + neg.sum(0)

        for batch in batches:
            for low in range(0, batch.num_rows, chunk):
                f = batch.slice(low, chunk).to_pandas()
                units, place = _coded(f, ["g"])
                named = [u[0] for u in units if u[0] is not None]
                weights = np.ones((len(units), len(every)))
                weights[[u[0] is not None for u in units]] = weigh(every, named)
                first = np.flatnonzero(np.concatenate([[True], np.diff(f["score"].to_numpy()) != 0]))
                pos, neg = (np.add.reduceat(f[c].to_numpy()[:, None] * weights[place], first, axis=0) for c in ("pos", "neg"))
                if least is None:
                    least = float(f["score"].iloc[0])
                if f["score"].iloc[0] == open_score:
                    pos[0] += open_pos
                    neg[0] += open_neg
                elif open_score is not None:
                    close(open_pos[None], open_neg[None])
                close(pos[:-1], neg[:-1])
                open_pos, open_neg, open_score = pos[-1], neg[-1], f["score"].iloc[-1]
        if least is not None:
            close(open_pos[None], open_neg[None])
            blocks = range(0, len(every), BLOCK)
            cut = lambda v: pa.array([v[k : k + BLOCK].tolist() for k in blocks], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK for k in blocks], pa.int32()), pa.array([least] * len(blocks)), cut(area), cut(all_pos), cut(all_neg)], ["block", "least", "area", "pos", "neg"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("least")  # a row for each range
        area, pos, neg = (np.stack(frame[c]) for c in ("area", "pos", "neg"))
        whole = (area + pos * (np.cumsum(neg, axis=0) - neg)).sum(0)
        of = pos.sum(0) * neg.sum(0)
        value = pd.Series(np.where(of > 0, whole / np.maximum(of, 1), np.nan)).astype(object).where(of > 0, None)
        return pd.DataFrame({"draw": int(frame["block"].iloc[0]) * BLOCK - 1 + np.arange(len(whole)), "auroc": value})

    ranged = counts.repartitionByRange("score").sortWithinPartitions("score")
    return ranged.select("g", "score", "pos", "neg").mapInArrow(run, "block int, least double, area array<double>, pos array<double>, neg array<double>").groupBy("block").applyInPandas(join, "draw int, auroc double")


def confusion_scores(sums: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(by, draw, macro, accuracy, classes, f1, support) per draw of arrays of counts (by, y, pred, block, v): ``classes`` have labels in the draw."""
    schema, _ = _types(sums, by)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = len(frame["v"].iloc[0])
        counts = np.zeros((k, k, wide))
        for y, p, v in zip(frame["y"], frame["pred"], frame["v"], strict=True):
            counts[int(y), int(p)] += v
        right, support, told = counts[range(k), range(k)], counts.sum(1), counts.sum(0)
        f1 = 2 * right / np.maximum(support + told, 1)
        total = counts.sum((0, 1))
        out = {b: [frame[b].iloc[0]] * wide for b in by}
        out |= {"draw": int(frame["block"].iloc[0]) * BLOCK - 1 + np.arange(wide), "macro": f1.mean(0), "accuracy": np.where(total > 0, right.sum(0) / np.maximum(total, 1), np.nan)}
        return pd.DataFrame(out | {"classes": (support > 0).sum(0), "f1": list(f1.T), "support": list(support.T.astype(np.int64))})

    return sums.groupBy(*by, "block").applyInPandas(run, f"{schema}{', ' if by else ''}draw int, macro double, accuracy double, classes int, f1 array<double>, support array<bigint>")


def model_draws(preds: DataFrame, k: int, draws: int, seed: object, group: str = "grp", numbers: Callable = mixed_numbers) -> DataFrame:
    """Scores of every ``model`` of ``preds`` in every draw, with groups weighted by Poisson(1), the same for all models."""
    rows = preds.groupBy(group, "model", "y", "pred").agg(F.count("*").alias("n"))
    return confusion_scores(vector_sums(rows, group, ["model", "y", "pred"], draws, hashed(numbers, poisson, seed)), k, ["model"])


def differences(scores: DataFrame, comparisons: DataFrame) -> DataFrame:
    """(comparison, draw, macro_a, macro_b, delta, accuracy_a, accuracy_b, classes) of declared (comparison, reference, candidate)."""
    side = lambda x, name: scores.select(F.col("model").alias(name), "draw", F.col("macro").alias(f"macro_{x}"), F.col("accuracy").alias(f"accuracy_{x}"), *(["classes"] if x == "a" else []))
    named = F.broadcast(comparisons)
    both = side("a", "reference").join(named, "reference").join(side("b", "candidate").hint("merge"), ["candidate", "draw"])
    return both.withColumn("delta", F.col("macro_b") - F.col("macro_a")).select("comparison", "draw", "macro_a", "macro_b", "delta", "accuracy_a", "accuracy_b", "classes")


def swaps(preds: DataFrame, comparisons: DataFrame, k: int, draws: int, seed: object, group: str = "grp", numbers: Callable = mixed_numbers) -> DataFrame:
    """(comparison, draw, delta): macro F1 differences when a coin per group and draw swaps both models' predictions. Draw -1 is the observed one.

    Only rows where the two differ are swapped: what a swap adds to one model's counts it takes from the other's.
    """
    named = F.broadcast(comparisons)
    side = lambda x, name: preds.select("id", group, "y", F.col("model").alias(name), F.col("pred").alias(f"p_{x}")).join(named, name)
    both = side("a", "reference").select("comparison", "id", group, "y", "p_a").join(side("b", "candidate").select("comparison", "id", "p_b").hint("merge"), ["comparison", "id"])
    cells = both.groupBy("comparison", group, "y", "p_a", "p_b").agg(F.count("*").alias("n"))
    as_is = F.lit(None).cast(cells.schema[group].dataType)
    row = lambda u, kind, p, n: F.struct(u.alias("u"), F.lit(kind).alias("kind"), p.alias("pred"), n.alias("n"))
    a, b, n, moved = F.col("p_a"), F.col("p_b"), F.col("n"), F.col("p_a") != F.col("p_b")
    own = F.array(row(as_is, "a", a, n), row(as_is, "b", b, n))
    more = F.array(row(F.col(group), "d", b, n), row(F.col(group), "d", a, -n))
    spread = cells.select("comparison", "y", F.explode(F.when(moved, F.concat(own, more)).otherwise(own)).alias("r")).select("comparison", "y", "r.*")
    spread = spread.groupBy("u", "comparison", "kind", "y", "pred").agg(F.sum("n").alias("n"))
    # In draw -1 every coin is 0, so nothing is swapped.
    tossed = hashed(numbers, coin, seed)
    weigh = lambda d, keys: np.where(d >= 0, tossed(d, keys), 0.0)
    sums = vector_sums(spread, "u", ["comparison", "kind", "y", "pred"], draws, weigh)
    swapped = sums.where("kind = 'd'").select("comparison", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("kind"), "y", "pred", "block", "v")
    swapped = swapped.withColumn("v", F.when(F.col("kind") == "b", F.transform("v", lambda x: -x)).otherwise(F.col("v")))
    scores = confusion_scores(sums.where("kind <> 'd'").unionByName(swapped), k, ["comparison", "kind"])
    return scores.groupBy("comparison", "draw").agg((F.max(F.when(F.col("kind") == "b", F.col("macro"))) - F.max(F.when(F.col("kind") == "a", F.col("macro")))).alias("delta"))


def two_sided(drawn: DataFrame, by: list[str]) -> DataFrame:
    """(by, observed, extreme, p) of (by, draw, delta): draws at least as far from 0 as the observed difference, (extreme + 1) / (draws + 1)."""
    seen = F.max(F.when(F.col("draw") < 0, F.col("delta"))).over(Window.partitionBy(*by))  # a row per draw, not per row of data
    told = drawn.withColumn("observed", seen).groupBy(*by, "observed").agg(
        F.count_if((F.col("draw") >= 0) & (F.abs("delta") >= F.abs("observed") - 1e-12)).alias("extreme"), F.count_if(F.col("draw") >= 0).alias("_n")
    )
    return told.select(*by, "observed", "extreme", ((F.col("extreme") + 1) / (F.col("_n") + 1)).alias("p"))


def comparisons_of(preds: DataFrame, comparisons: DataFrame, k: int, boot: int, rand: int, seed: object, group: str = "grp", numbers: Callable = mixed_numbers) -> DataFrame:
    """All declared comparisons (comparison, reference, candidate): point, interval, p, Holm p and superiority, from the same draws of all models."""
    from cohortspark.operators.resample import interval
    from cohortspark.operators.select import holm

    needed = comparisons.select("reference").union(comparisons.select("candidate")).distinct().withColumnRenamed("reference", "model")
    used = preds.join(F.broadcast(needed), "model", "left_semi")
    boots = interval(differences(model_draws(used, k, boot, seed, group, numbers), comparisons), by=("comparison",))
    tests = two_sided(swaps(used, comparisons, k, rand, f"{seed}r", group, numbers), ["comparison"]).select("comparison", "p")
    out = holm(boots.join(tests.hint("merge"), "comparison").withColumn("_all", F.lit(1)), ["_all"], name="comparison").drop("_all")
    return out.select("comparison", "point", "low", "high", "p", "p_holm", ((F.col("low") > 0) & (F.col("p_holm") <= 0.05)).alias("superior"))


def _percentiles(value: Column) -> Column:
    return F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))


def locked_intervals(pairs: DataFrame, k: int, draws: int, seed: int, group: str = "grp", tries: int = 8) -> DataFrame:
    """(metric, role, point, row_low, row_high, group_low, group_high, rejected, draws) of (group, y, pred_a, pred_b): 95 % intervals side by side.

    Rows are drawn anew inside their class; groups are drawn anew as a whole, as many as there are, and draws in which a class has no
    label are rejected and made up for by later ones, ``tries`` times ``draws`` in all at most. Roles: reference, candidate, delta.
    """
    sides = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"pred_{x}").alias("pred")) for m, x in (("reference", "a"), ("candidate", "b"))])).alias("s")
    joint = pairs.groupBy("y", "pred_a", "pred_b").agg(F.count("*").alias("mass"))
    one = joint.select("y", "pred_a", "pred_b", "mass", sides).select("y", "pred_a", "pred_b", "mass", "s.model", "s.pred", F.lit(1).alias("n"))
    rows = confusion_scores(multinomial_sums(one, ["y", "pred_a", "pred_b"], ["model", "y", "pred"], draws, seed, "y", "mass"), k, ["model"])
    counts = pairs.select(group, "y", sides).groupBy(group, "y", "s.model", "s.pred").agg(F.count("*").alias("n"))
    for more in (1, 2, tries):
        whole = materialize(confusion_scores(multinomial_sums(counts, [group], ["model", "y", "pred"], more * draws, seed + 1), k, ["model"]))
        complete = whole.where(F.col("draw") >= 0).where(F.col("model") == "reference").select("draw", (F.col("classes") == k).alias("good"))
        at = complete.orderBy("draw").collect()  # a row per draw
        good = [r["draw"] for r in at if r["good"]][:draws]
        if len(good) == draws:
            break
    else:
        raise ValueError("too few draws of groups have labels of every class")
    rejected = good[-1] + 1 - draws

    def told(scores: DataFrame, name: str) -> DataFrame:
        flat = scores.select("draw", F.col("model").alias("role"), F.explode(F.create_map(F.lit("macro_f1"), "macro", F.lit("accuracy"), "accuracy")).alias("metric", "value"))
        delta = flat.groupBy("draw", "metric").agg(
            (F.max(F.when(F.col("role") == "candidate", F.col("value"))) - F.max(F.when(F.col("role") == "reference", F.col("value")))).alias("value")
        )
        every = flat.unionByName(delta.withColumn("role", F.lit("delta")))
        out = every.groupBy("metric", "role").agg(F.max(F.when(F.col("draw") < 0, F.col("value"))).alias("point"), _percentiles(F.when(F.col("draw") >= 0, F.col("value"))).alias("q"))
        return out.select("metric", "role", *(["point"] if name == "row" else []), F.col("q")[0].alias(f"{name}_low"), F.col("q")[1].alias(f"{name}_high"))

    both = told(rows, "row").join(told(whole.where(F.col("draw") <= good[-1]).where((F.col("draw") < 0) | F.col("draw").isin(good) if rejected else F.lit(True)), "group").hint("merge"), ["metric", "role"])
    return both.withColumns({"rejected": F.lit(rejected), "draws": F.lit(draws)})


def method_intervals(preds: DataFrame, k: int, draws: int, seed: int, champion: str, reference: str) -> DataFrame:
    """(metric, role, mean, low, high, p_positive, draws): every model's mean and interval over draws of rows inside their class, and the champion's gain.

    Rows with the same label and the same predictions of all models are one unit, drawn by its number of rows, so that all models meet the same rows in a draw.
    """
    joint = preds.groupBy("id", "y").agg(F.sort_array(F.collect_list(F.struct("model", F.col("pred").cast("int").alias("pred")))).alias("told"))
    units = joint.groupBy("y", F.to_json("told").alias("unit")).agg(F.count("*").alias("mass"), F.first("told").alias("told"))
    one = units.select("y", "unit", "mass", F.explode("told").alias("t")).select("y", "unit", "mass", "t.model", "t.pred", F.lit(1).alias("n"))
    scores = confusion_scores(multinomial_sums(one, ["y", "unit"], ["model", "y", "pred"], draws, seed, "y", "mass"), k, ["model"])
    flat = scores.where("draw >= 0").select("draw", F.col("model").alias("role"), F.explode(F.create_map(F.lit("macro_f1"), "macro", F.lit("accuracy"), "accuracy")).alias("metric", "value"))
    gain = flat.groupBy("draw", "metric").agg((F.max(F.when(F.col("role") == champion, F.col("value"))) - F.max(F.when(F.col("role") == reference, F.col("value")))).alias("value"))
    every = flat.unionByName(gain.withColumn("role", F.lit(f"{champion} - {reference}")))
    out = every.groupBy("metric", "role").agg(F.avg("value").alias("mean"), _percentiles(F.col("value")).alias("q"), F.avg((F.col("value") > 0).cast("double")).alias("p_positive"), F.count("*").alias("draws"))
    return out.select("metric", "role", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "p_positive", "draws")
