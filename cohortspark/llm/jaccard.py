"""N-gram Jaccard join by vertical partitioning.

All shingles have one global order: rare ones first (by counts over the whole corpus in 2 ** 30 cells), then by hash.
The order decides what a search costs, not what it finds. It is cut into fragments. Two documents that reach the
threshold must share a shingle in the early part of their sets (prefix filter), which gives candidates; a candidate
pair's overlap is then counted fragment by fragment, each fragment on its own, and the partial counts are summed per
pair. No pair that reaches the threshold is missed.

Documents with equal sets form a class, of which one member takes part. Candidates come in two passes, so that a group
of n near copies doesn't cost n * n pairs: first every document of a shingle's list meets the document that
comes earliest in it; what these pairs link becomes one component. Then all pairs of a list that still lie in
different components are compared, by steps of size: sets whose sizes differ by more never meet. Sizes and places in
the order leave out pairs that can't reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.shingles import WIDTH, set_digest, shingle_sets, tidy
from cohortspark.operators.components import connected_components
from cohortspark.sources.tables import BROADCAST_ROWS, materialize, sized

#: Shingles are counted in 2 ** BITS cells, in blocks of 2 ** 16 that tasks sum one at a time: the whole is nowhere held.
BITS = 30
#: Members that a task counts before it hands them on, cells that every task may be told of, and the least count told.
WAITING, TOLD, LEAST = 1_000_000, 4_000_000, 12
#: Fragments of the global order. The last one holds the frequent shingles.
FRAGMENTS = 8
#: Fragments that are counted first; pairs that these rule out are not counted further.
EARLY = 2
PERCENT = 75


def _cells(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)


def _binary(parts: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """``parts`` cut at ``cuts`` (places in it, from 0 to its length) as binary values."""
    raw = np.ascontiguousarray(parts)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])


COUNTED = "block int, cells binary, many binary, counts binary"


def _counted(members: list[np.ndarray], bits: int) -> list[pa.Array]:
    """Blocks of counts: (block, its cells, those of them over 1, their counts)."""
    cells, n = np.unique(_cells(np.concatenate(members), bits), return_counts=True)
    blocks, first = np.unique(cells >> 16, return_index=True)
    many = n > 1
    before = np.concatenate(([0], np.cumsum(many)))
    cuts = np.append(first, len(cells))
    low = (cells & 0xFFFF).astype("<u2")
    return [pa.array(blocks.astype(np.int32)), _binary(low, cuts), _binary(low[many], before[cuts]), _binary(n[many].astype("<u4"), before[cuts])]


def _describe(width: int, bits: int):
    """Per row (doc_id, n_shingles, node: the digest of its set); besides, blocks of counts of the members' cells."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "node", "block", "cells", "many", "counts"]
        waiting, size = [], 0

        def counts() -> pa.RecordBatch:
            told = _counted(waiting, bits)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(told[0]), pa.int64())] * 3 + told, names)

        for batch in batches:
            sizes, nodes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, members in shingle_sets(batch.column(1), width):
                sizes[row], nodes[row] = len(members), set_digest(members)
                waiting.append(members)
                size += len(members)
                if size > WAITING:
                    yield counts()
                    size = 0
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(nodes), pa.nulls(batch.num_rows, pa.int32()), none, none, none], names)
        if size:
            yield counts()

    return run


def _over(bound: int):
    """Rows of COUNTED in order of the block to (level, n, cells): the cells over ``bound``, by the logarithm of what they are over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << 16, np.int64)
        found: list[tuple[int, int, bytes]] = []

        def settle() -> None:
            cells = np.flatnonzero(total > bound)
            level = np.log2(total[cells] - bound).astype(np.int64) + 1
            for k in np.unique(level):
                own = ((now << 16) + cells[level == k]).astype("<u4")
                found.append((int(k), len(own), own.tobytes()))
            total[:] = 0

        def told() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else ([], [], [])
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["level", "n", "cells"])
            found.clear()
            return out

        for batch in batches:
            for block, cells, many, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now is not None:
                        settle()
                    now = block
                total[np.frombuffer(cells, "<u2")] += 1
                total[np.frombuffer(many, "<u2")] += np.frombuffer(counts, "<u4").astype(np.int64) - 1
            yield told()
        if now is not None:
            settle()
            yield told()

    return run


class Frequent:
    """Frequency levels of cells: those of the frequent ones, 0 for all others."""

    FOLD = 27

    def __init__(self, cells: np.ndarray, levels: np.ndarray, bits: int = BITS):
        order = np.argsort(cells)
        self.cells, self.of, self.bits, self.seen = cells[order], levels[order], bits, None

    def levels(self, members: np.ndarray) -> np.ndarray:
        cells = _cells(members, self.bits)
        shift = np.uint32(max(0, self.bits - self.FOLD))
        if self.seen is None:  # a bit for each group of cells: most members are told apart by it
            self.seen = np.zeros(1 << (min(self.bits, self.FOLD) - 3), np.uint8)
            folded = self.cells >> shift
            np.bitwise_or.at(self.seen, folded >> 3, np.uint8(1) << (folded & 7).astype(np.uint8))
        folded = cells >> shift
        out = np.zeros(len(cells), np.uint8)
        hit = np.flatnonzero(self.seen[folded >> 3] >> (folded & 7).astype(np.uint8) & 1)
        if len(hit):
            at = np.minimum(np.searchsorted(self.cells, cells[hit]), len(self.cells) - 1)
            out[hit] = np.where(self.cells[at] == cells[hit], self.of[at], 0)
        return out

    def __getstate__(self):
        return self.__dict__ | {"seen": None}


def frequent(described: DataFrame, bits: int = BITS, most: int = TOLD) -> Frequent:
    """The cells whose count is more than chance alone puts there, the most frequent ones if these are more than ``most``.

    Cells are summed block by block where they lie; what is told to the driver and to the tasks has a fixed bound.
    """
    usual = (described.agg(F.sum("n_shingles")).first()[0] or 0) / float(1 << bits)
    bound = max(LEAST, int(usual + 4 * math.sqrt(usual) + 2))
    rows = described.where("block IS NOT NULL").select("block", "cells", "many", "counts").repartition("block").sortWithinPartitions("block")
    over = materialize(rows.mapInArrow(_over(bound), "level int, n long, cells binary"))
    room, least = most, 256
    for level, n in sorted(map(tuple, over.groupBy("level").agg(F.sum("n")).collect()), reverse=True):  # one row per level
        if n > room:
            break
        room, least = room - n, level
    found = over.where(F.col("level") >= least).select("level", "cells").collect()  # ``most`` cells at most
    cells = [np.frombuffer(r.cells, "<u4") for r in found]
    levels = np.repeat(np.array([r.level for r in found], np.uint8), [len(c) for c in cells])
    return Frequent(np.concatenate(cells) if cells else np.zeros(0, np.uint32), levels, bits)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many first members of a set of n may hold the first common one of a pair that reaches the threshold."""
    return n - -(-percent * n // 100) + 1


def _postings(levels, width: int, percent: int):
    """(doc_id, node, digest, text) to (h, node, n and pos in one number) for the first members of each set in the global order.

    40 bits of a hash are enough to find candidates, and shuffle better.
    """

    def told(out: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["h", "node", "place"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = levels.value
        for batch in batches:
            nodes, digests = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            out, size = [[], [], []], 0
            for row, members in shingle_sets(batch.column(3), width):
                n = len(members)
                if not n or set_digest(members) != digests[row]:
                    continue
                k = prefix_length(n, percent)
                first = members[np.argsort(known.levels(members), kind="stable")[:k]]
                out[0].append((first >> np.uint64(24)).view(np.int64))
                out[1].append(np.full(k, nodes[row]))
                out[2].append((n << 32) + np.arange(k))
                size += k
                if size > 200_000:
                    yield told(out)
                    out, size = [[], [], []], 0
            if size:
                yield told(out)

    return run


def _segments(levels, width: int, fragments: int, early: bool):
    """(doc_id, node, digest, text) to (node, fragment, members): the sets cut at the borders of the global order's fragments.

    ``early`` gives the first ``EARLY`` fragments, else the others.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = levels.value
        borders = (np.arange(1, fragments - 1, dtype=np.float64) / (fragments - 1) * 2.0**64).astype(np.uint64)
        for batch in batches:
            nodes, digests = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            own, part, members_of = [], [], []
            for row, members in shingle_sets(batch.column(3), width):
                if not len(members) or set_digest(members) != digests[row]:
                    continue
                common = known.levels(members) > 0
                rare = members[~common]
                for k, piece in enumerate([*np.split(rare, np.searchsorted(rare, borders)), members[common]]):
                    if len(piece) and (k < EARLY) == early:
                        own.append(nodes[row])
                        part.append(k)
                        members_of.append(piece.view(np.int64))
                if len(own) > 2000:
                    yield _segment_batch(own, part, members_of)
                    own, part, members_of = [], [], []
            if own:
                yield _segment_batch(own, part, members_of)

    return run


def _segment_batch(own: list, part: list, members: list) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in members]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(members)))
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(part, pa.int32()), lists], ["node", "fragment", "members"])


@dataclass
class _Corpus:
    """``docs`` and its classes of equal sets: nodes (node, digest, doc_id, again); ``few`` if they may be broadcast, ``repeated`` if some stand in several rows."""

    docs: DataFrame
    nodes: DataFrame
    few: bool
    repeated: bool

    def texts(self, nodes: DataFrame, few: bool) -> DataFrame:
        """(doc_id, node, digest, text) once for each of ``nodes``. Only texts of doc_ids that stand in several equal rows are
        shuffled to keep one of them."""
        found = self.docs.join(_side(nodes.select("doc_id", "node", "digest", "again"), few), "doc_id").select("doc_id", "node", "digest", "text", "again")
        if not self.repeated:
            return found.drop("again")
        return found.where("NOT again").drop("again").unionByName(found.where("again").drop("again").dropDuplicates(["node", "digest", "text"]))


def _side(side: DataFrame, few: bool) -> DataFrame:
    """A side with a join hint: broadcast if it is known to have ``BROADCAST_ROWS`` rows at most."""
    return F.broadcast(side) if few else side.hint("merge")


def _fits(percent: int, a: str = "a", b: str = "b") -> str:
    """A pair that can still reach the threshold if this is its first common member: by sizes, and by what is left of both."""
    rest = f"1 + least({a}.n - {a}.pos, {b}.n - {b}.pos) - 1"
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND ({rest}) * {100 + percent} >= {percent} * ({a}.n + {b}.n)"


def _partial(corpus: _Corpus, pairs: DataFrame, few: bool, levels, width: int, fragments: int, early: bool) -> DataFrame:
    """(a, b, common, sa, sb) summed over some fragments: common members and the sizes of both cuts. Pairs that have none of them are missing."""
    sides = pairs.select(F.col("a").alias("node"), "a", "b", F.lit(0).alias("side")).unionByName(pairs.select(F.col("b").alias("node"), "a", "b", F.lit(1).alias("side")))
    wanted = corpus.nodes.join(_side(sides.select("node").distinct(), few), "node")
    cut = corpus.texts(wanted, few or corpus.few).mapInArrow(_segments(levels, width, fragments, early), "node long, fragment int, members array<long>")
    met = cut.join(_side(sides, few), "node").groupBy("a", "b", "fragment").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("side", "members")))).alias("x"))  # texts of one set give equal members
    first, second = (F.try_element_at(F.col("x"), F.lit(k)) for k in (1, 2))
    own = lambda side: F.when(first["side"] == side, F.size(first["members"])).when(second["side"] == side, F.size(second["members"])).otherwise(0)
    common = F.coalesce(F.size(F.array_intersect(first["members"], second["members"])), F.lit(0))
    counted = met.select("a", "b", F.when(second.isNull(), 0).otherwise(common).alias("common"), own(0).alias("sa"), own(1).alias("sb"))
    return counted.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("common", "sa", "sb")])


def _verified(corpus: _Corpus, pairs: DataFrame, levels, width: int, percent: int, fragments: int) -> DataFrame:
    """Those of the written ``pairs`` (a, b, na, nb) that reach the threshold, written.

    Partial overlaps are counted in the early fragments first. Pairs that can't reach the threshold whatever the other
    fragments hold are left; for the rest the other fragments are counted too and all are summed.
    """
    n = pairs.count()
    if not n:
        return pairs.select("a", "b", F.lit(0).cast("long").alias("common"))
    few = 2 * n <= BROADCAST_ROWS
    early = pairs.join(_partial(corpus, pairs, few, levels, width, fragments, True).hint("merge"), ["a", "b"], "left").na.fill(0, ["common", "sa", "sb"])
    open_ = materialize(early.where(f"{100 + percent} * (common + least(na - sa, nb - sb)) >= {percent} * (na + nb)").select("a", "b", "na", "nb", "common"))
    late = _partial(corpus, open_, few, levels, width, fragments, False).select("a", "b", F.col("common").alias("more"))
    summed = open_.join(late.hint("merge"), ["a", "b"], "left").withColumn("common", F.col("common") + F.coalesce("more", F.lit(0)))
    return materialize(summed.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b", "common"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, fragments: int = FRAGMENTS, bits: int = BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id.

    Rows link when their sets' Jaccard similarity is at least ``percent`` / 100; component_id is the smallest doc_id that
    links reach. Null or wordless text has n_shingles 0 and stands alone. Rows with a null doc_id take no part and have a
    null component_id. Equal rows give equal rows; a doc_id with different texts is looked at text by text. An
    empty table gives an empty result; other columns are ignored. Sets are compared by 64-bit hashes.
    """
    return _marked(docs, width, percent, fragments, bits).select("doc_id", "n_shingles", "component_id")


def _marked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, fragments: int = FRAGMENTS, bits: int = BITS) -> DataFrame:
    """``jaccard_components`` with each row's digest of its set."""
    docs = docs.select("doc_id", "text")
    described = materialize(docs.mapInArrow(_describe(width, bits), f"doc_id long, n_shingles long, node long, {COUNTED}"))
    rows = described.where("block IS NULL").select("doc_id", "n_shingles", F.col("node").alias("digest"))
    nodes = materialize(_nodes(rows))
    n, repeated = nodes.agg(F.count("*"), F.count_if("again")).first()
    corpus = _Corpus(docs, nodes, n <= BROADCAST_ROWS, repeated > 0)
    levels = docs.sparkSession.sparkContext.broadcast(frequent(described, bits))

    postings = corpus.texts(nodes, corpus.few).mapInArrow(_postings(levels, width, percent), "h long, node long, place long")
    listed = Window.partitionBy("h")
    n, pos = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    lists = materialize(
        postings.withColumn("first", F.min(F.struct((pos / n).alias("at"), "node", "place")).over(listed))
        .withColumn("last", F.max("node").over(listed))
        .withColumn("least", F.min("node").over(listed))
        .where("least < last")
        .select("h", "node", n.cast("int").alias("n"), pos.cast("int").alias("pos"), F.col("first.node").alias("node0"), F.col("first.place").alias("place"))
        .select("h", "node", "n", "pos", "node0", n.cast("int").alias("n0"), pos.cast("int").alias("pos0"))
    )
    met = (
        lists.select(F.struct("node", "n", "pos").alias("a"), F.struct(F.col("node0").alias("node"), F.col("n0").alias("n"), F.col("pos0").alias("pos")).alias("b"))
        .where("a.node <> b.node AND " + _fits(percent))
    )
    pairs = materialize(_pairs(met))
    links = _verified(corpus, pairs, levels, width, percent, fragments)
    joined = materialize(connected_components(links, "a", "b"))

    label = lists.select("h", "node", "n", "pos").join(sized(joined.select(F.col("id").alias("node"), "component")), "node", "left")
    label = label.withColumn("component", F.coalesce("component", "node"))
    mixed = materialize(
        label.withColumn("low", F.min("component").over(listed)).withColumn("high", F.max("component").over(listed)).where("low < high").drop("low", "high")
    )
    step = F.floor(F.log("n") / F.lit(math.log(100 / percent) + 1e-6)).cast("int")  # sizes of a link are at most one step apart
    b = mixed.select("h", step.alias("step"), F.struct("node", "n", "pos", "component", step.alias("step")).alias("b")).hint("merge")
    a = mixed.select("h", F.explode(F.array(step, step + 1)).alias("step"), F.struct("node", "n", "pos", "component", step.alias("step")).alias("a")).hint("merge")
    apart = "(a.step < b.step OR a.node < b.node) AND a.component <> b.component AND "
    crossed = a.join(b, ["h", "step"]).where(apart + _fits(percent)).select("a", "b")
    more = materialize(_pairs(crossed).join(pairs.hint("merge"), ["a", "b"], "left_anti"))
    links = _verified(corpus, more, levels, width, percent, fragments)
    levels.destroy()
    if not links.isEmpty():  # the components so far are stars, which the new links join
        stars = joined.select(F.col("id").alias("a"), F.col("component").alias("b"))
        joined = connected_components(stars.unionByName(links.select("a", "b")), "a", "b")
    joined = joined.select(F.col("id").alias("node"), "component")

    placed = nodes.join(joined.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(ids.hint("merge"), "component").select("digest", "component_id")
    linked = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").join(placed.hint("merge"), "digest").select("doc_id", "digest", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "digest", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _nodes(rows: DataFrame) -> DataFrame:
    """(node, digest, doc_id, again): a class of equal sets, the smallest doc_id that has it, whether that doc_id has it in several rows.

    A class goes by that doc_id, or by its digest if the doc_id stands for several classes.
    """
    sets = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    least = sets.groupBy("digest").agg(F.min(F.struct("doc_id", "n")).alias("x")).select("digest", "x.doc_id", (F.col("x.n") > 1).alias("again"))
    shared = least.groupBy("doc_id").agg(F.count("*").alias("classes"))
    return least.join(shared.hint("merge"), "doc_id").select(F.when(F.col("classes") == 1, F.col("doc_id")).otherwise(F.col("digest")).alias("node"), "digest", "doc_id", "again")


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct (a, b, na, nb) with a < b from rows of two structs."""
    swap = "a.node < b.node"
    return met.selectExpr(
        f"if({swap}, a.node, b.node) AS a", f"if({swap}, b.node, a.node) AS b", f"if({swap}, a.n, b.n) AS na", f"if({swap}, b.n, a.n) AS nb"
    ).distinct()


def _digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.zeros(batch.num_rows, np.int64)
            for row, members in shingle_sets(batch.column(1), width):
                got[row] = set_digest(members)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*batch.schema.names, "digest"])

    return run


def keep_one(docs: DataFrame, width: int = WIDTH, **how) -> DataFrame:
    """``docs``, with all its columns, with one row of each component: that of the smallest doc_id.

    A doc_id with several rows stays once, if it is the smallest of a component: with a text of that component, the least
    one if there are several. Null and wordless texts are components of their own; rows with a null doc_id all stay. An
    empty table stays empty; columns may have any names.
    """
    own = F.col("component_id") == F.col("doc_id")
    marked = _marked(docs, width, **how).where("doc_id IS NOT NULL").groupBy("doc_id")
    kept = materialize(marked.agg(F.count("*").alias("n"), F.min(F.when(own, F.col("digest"))).alias("digest")).where("digest IS NOT NULL"))
    rows = docs.select(F.col("doc_id").alias("id"), F.struct("*").alias("row"))
    on = lambda side: F.col("id") == side["doc_id"]
    once, again = kept.where("n = 1"), kept.where("n > 1")
    side = sized(once.select("doc_id"))
    single = rows.join(side, on(side)).select("row")
    side = sized(again.select("doc_id", F.col("digest").alias("wanted")))
    several = rows.join(side, on(side)).select("id", F.col("row.text").alias("text"), "wanted", "row")
    texts = several.select("id", "text", "wanted").mapInArrow(_digests(width), "id long, text string, wanted long, digest long")
    least = materialize(texts.where("digest = wanted").groupBy("id").agg(F.min(F.struct("text")).alias("x")).select("id", "x.text"))
    same = several.alias("s").join(least.alias("l").hint("merge"), F.expr("s.id = l.id AND s.text <=> l.text")).select("s.id", "s.row")
    place = Window.partitionBy("id").orderBy(F.xxhash64(F.to_json("row")))
    many = same.withColumn("at", F.row_number().over(place)).where("at = 1").select("row")
    return single.unionByName(many).unionByName(rows.where("id IS NULL").select("row")).select("row.*")
