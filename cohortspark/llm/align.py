"""Alignment of two tokenizers' tokens over the same bytes, by galloping intersection of their token ends.

Tokens of a text end at byte offsets, an ascending list for each tokenizer. The ends of the shorter list look for themselves in the
longer one by steps of doubling length and a binary search between the last two. Common ends cut both token lists into groups; the
differences of their ranks say which tokens of either side overlap. A link is a pair of tokens in one group.

Neither tokenizer joins anything across a blank after a visible character, so texts are cut there, the stretches are aligned once each,
and a text's result is put together from those of its stretches.

Counts of linked pairs are over the corpus. Each task packs its documents' distinct pairs into bundles, by the A id's remainder; bundles
are counted where they lie, and counts meet bundles again by that part, so that no step holds more than the pairs of one part.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm import bpe
from cohortspark.llm.shingles import chunks, text_bytes, tidy
from cohortspark.sources.tables import materialize

#: Parts of the A ids, slices of text whose bundles of one part meet in one task, bytes of text in a slice, stretches a worker remembers.
PARTS, SLICES, SLICE, STRETCHES_KEPT = 32, 1_500, 1 << 21, 250_000
#: Pairs expanded, and counts held by a task, at a time.
EXPANDED, COUNTED = 1 << 21, 1 << 22
BLANK = "▁"


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def gallop(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Place of each of ``values`` in its own ascending stretch longer[lo:hi], which isn't empty; -1 where it isn't there."""
    low, high = lo.copy(), lo.copy()
    at, step = np.arange(len(values)), 1
    while len(at):  # doubling steps, until the end of one isn't below the value
        high[at] = np.minimum(lo[at] + (step - 1), hi[at] - 1)
        short = (longer[high[at]] < values[at]) & (high[at] < hi[at] - 1)
        at = at[short]
        low[at] = high[at] + 1
        step *= 2
    at = np.flatnonzero(low < high)
    while len(at):  # halving the last step
        middle = (low[at] + high[at]) >> 1
        below = longer[middle] < values[at]
        low[at[below]] = middle[below] + 1
        high[at[~below]] = middle[~below]
        at = at[low[at] < high[at]]
    return np.where(longer[low] == values, low, -1)


def common_ends(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and ``b`` of the ends that both have, for many texts: text k's ends are a[a_at[k]:a_at[k + 1]] and likewise in b.

    In every text the shorter list drives the search in the longer one.
    """
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    found = []
    for driver, d_at, other, o_at, mine in ((a, a_at, b, b_at, n_a <= n_b), (b, b_at, a, a_at, n_b < n_a)):
        text = np.repeat(np.arange(len(n_a)), np.diff(d_at))
        rank = np.flatnonzero(mine[text])
        text = text[rank]
        keep = o_at[text] < o_at[text + 1]
        rank, text = rank[keep], text[keep]
        place = gallop(driver[rank], o_at[text], o_at[text + 1], other)
        hit = place >= 0
        found.append((rank[hit], place[hit]))
    in_a = np.concatenate([found[0][0], found[1][1]])
    in_b = np.concatenate([found[0][1], found[1][0]])
    order = np.argsort(in_a, kind="stable")
    return in_a[order], in_b[order]


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, … of ``sizes[k]`` numbers each, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights[order], first)


def _joined(texts: pa.Array, at: np.ndarray, mark: str) -> pa.Array:
    """texts[at[k]:at[k + 1]] joined, for each k."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), texts), pa.scalar(mark, pa.large_string()))


class Aligner:
    """Both tokenizers, and what is known of stretches of text."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = bpe.PrefixEncoder(path_a)
        self.a.added = {}  # their strings are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("pieces of B go across words")
        self.wide = len(pieces)
        self.table_b = pa.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)], pa.large_binary())
        self.blank = self.b.piece_to_id(BLANK)
        self.forget()

    def forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.numbers = np.zeros((0, 5), np.int64)  # whether both give back the bytes, A tokens, B tokens, groups, links
        self.told = pa.array([], pa.large_string())
        self.pairs, self.times, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with a blank, which B itself puts there, and where each one's begin."""
        got = [ids or [self.blank] for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]
        at = np.zeros(len(got) + 1, np.int64)
        np.cumsum([len(x) for x in got], out=at[1:])
        return np.fromiter(itertools.chain.from_iterable(got), np.int64, int(at[-1])), at

    def compare(self, raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """Tokens and common ends of the texts raw[at[k]:at[k + 1]], which begin with a blank each."""
        whole, ends = raw.tobytes(), at.tolist()
        ids_a, a_at = self.a.encode(raw, at)
        ids_b, b_at = self.encode_b([whole[x:y].decode() for x, y in zip(ends[:-1], ends[1:], strict=True)])
        good = np.ones(len(at) - 1, bool)
        sides = {"a": (ids_a.astype(np.int64), a_at, self.a.table), "b": (ids_b, b_at, self.table_b)}
        for ids, own, table in sides.values():
            taken = table.take(pa.array(ids))
            _, offsets, data = taken.buffers()
            first = np.frombuffer(offsets, np.int64)[: len(ids) + 1][own].tolist()
            joined = data.to_pybytes()[: first[-1]] if data is not None else b""
            if joined != whole or first != ends:
                good &= [joined[x:y] == whole[u:v] for x, y, u, v in zip(first[:-1], first[1:], ends[:-1], ends[1:], strict=True)]
        out = {}
        for side, (ids, own, table) in sides.items():
            sizes = np.where(good, np.diff(own), 0)
            ids = ids[np.repeat(good, np.diff(own))]
            # Texts without tokens count no bytes on either side, so ends of the others stay comparable.
            lengths = pc.binary_length(table.take(pa.array(ids))).to_numpy()
            out |= {side: ids, f"{side}_at": np.concatenate([[0], np.cumsum(sizes)]), f"{side}_ends": np.cumsum(lengths)}
        out["good"] = good
        out["in_a"], out["in_b"] = common_ends(out["a_ends"], out["a_at"], out["b_ends"], out["b_at"])
        return out

    def _groups(self, c: dict[str, np.ndarray]) -> tuple[np.ndarray, pa.Array]:
        """(groups of each text, their ids as text)."""
        sizes = [np.diff(c[f"in_{s}"], prepend=-1) for s in "ab"]
        own = np.searchsorted(c["in_a"], c["a_at"])
        sides = []
        for side, size in zip("ab", sizes, strict=True):
            sides.append(_joined(pa.array(c[side]).cast(pa.large_string()), np.concatenate([[0], np.cumsum(size)]), ","))
        return np.diff(own), _joined(pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())), own, ";")

    def _links(self, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of the distinct pairs of each text, and the links of each group; a pair is A id * number of B ids + B id."""
        n = len(c["in_a"])
        ids, times, first, many, sizes = [], [], [], [], []
        for side in "ab":
            size = np.diff(c[f"in_{side}"], prepend=-1)
            keys, count = np.unique(np.repeat(np.arange(n), size) << 32 | c[side], return_counts=True)
            at = np.searchsorted(keys >> 32, np.arange(n + 1))
            ids.append(keys & 0xFFFFFFFF)
            times.append(count)
            first.append(at[:-1])
            many.append(np.diff(at))
            sizes.append(size)
        text = np.repeat(np.arange(len(c["a_at"]) - 1), np.diff(np.searchsorted(c["in_a"], c["a_at"])))
        ends = np.cumsum(many[0] * many[1])
        space = self.wide * len(self.a.table)
        keys, weights = [], []
        for low in range(0, int(ends[-1]) if n else 0, EXPANDED):
            place = np.arange(low, min(low + EXPANDED, int(ends[-1])))
            group = np.searchsorted(ends, place, "right")
            inner = place - (ends - many[0] * many[1])[group]
            x, y = first[0][group] + inner // many[1][group], first[1][group] + inner % many[1][group]
            k, w = _summed(text[group] * space + ids[0][x] * self.wide + ids[1][y], times[0][x] * times[1][y])
            keys.append(k)
            weights.append(w)
        k, w = _summed(np.concatenate(keys), np.concatenate(weights)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return k // space, k % space, w, np.bincount(text, sizes[0] * sizes[1], len(c["a_at"]) - 1).astype(np.int64)

    def learn(self, stretches: list[bytes]) -> None:
        """Adds new stretches to what is known."""
        at = np.zeros(len(stretches) + 1, np.int64)
        np.cumsum([len(x) for x in stretches], out=at[1:])
        c = self.compare(np.frombuffer(b"".join(stretches), np.uint8), at)
        groups, told = self._groups(c)
        text, pairs, times, links = self._links(c)
        self.numbers = np.concatenate([self.numbers, np.stack([c["good"], np.diff(c["a_at"]), np.diff(c["b_at"]), groups, links], axis=1)])
        self.told = pa.concat_arrays([self.told, told])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])
        self.at = np.concatenate([self.at, self.at[-1] + np.searchsorted(text, np.arange(1, len(stretches) + 1))])

    def texts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that begin with a blank each: (text, [good, A, B, groups, links]), digests, and (text, pair, times) of their distinct pairs."""
        begins = stretches_of(raw, at[:-1])
        ends = np.append(begins, len(raw)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.places) + len(distinct) > STRETCHES_KEPT:
            self.forget()
        new = [s for s in distinct if s not in self.places]
        if new:
            self.places |= {s: len(self.places) + k for k, s in enumerate(new)}
            self.learn(new)
        place = np.array([self.places[s] for s in distinct], np.int64)[coded.indices.to_numpy()]
        own = np.searchsorted(begins, at)
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.numbers[place], axis=0)])
        numbers = sums[own[1:]] - sums[own[:-1]]
        good = numbers[:, 0] == np.diff(own)
        numbers[~good] = 0
        told = _joined(self.told.take(pa.array(place)), own, ";")
        digests = [hashlib.sha256(t.encode()).hexdigest() if g else "" for t, g in zip(told.to_pylist(), good.tolist(), strict=True)]
        text = np.repeat(np.arange(len(good)), np.diff(own))
        used, count = np.unique((text << 32 | place)[good[text]], return_counts=True)
        stretch = used & 0xFFFFFFFF
        sizes = np.diff(self.at)[stretch]
        at_pair = _spread(self.at[stretch], sizes)
        space = self.wide * len(self.a.table)
        keys, times = _summed(np.repeat(used >> 32, sizes) * space + self.pairs[at_pair], np.repeat(count, sizes) * self.times[at_pair])
        return numbers, digests, keys // space, keys % space, times


def stretches_of(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where stretches begin: at each text, and at each blank after a character that isn't white space."""
    cut = raw == 32
    before = np.concatenate([np.zeros(3, np.uint8), raw])
    one, two = before[2:-1], before[1:-2]
    # White space beyond ASCII ends in these bytes of UTF-8; a few other characters that do aren't cut after either.
    wide = np.isin(one, [0x85, 0xA0, 0x9F, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]) & np.isin(two, [0xC2, 0x80, 0x81, 0x9A])
    cut &= ~((one == 32) | (one >= 9) & (one <= 13) | wide)
    cut[starts] = True
    return np.flatnonzero(cut)


@functools.cache
def aligner(paths: tuple[str, str]) -> Aligner:
    """One for each Python worker, which serves many tasks."""
    return Aligner(*paths)


def _blanked(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, rows): the texts that aren't empty, with a blank before each."""
    rows = np.flatnonzero(np.diff(at))
    whole = raw[at[0] : at[-1]].tobytes()
    parts = [whole[x:y] for x, y in zip((at[rows] - at[0]).tolist(), (at[rows + 1] - at[0]).tolist(), strict=True)]
    joined = b"".join(x for p in parts for x in (b" ", p))
    return np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum(at[rows + 1] - at[rows] + 1)]), rows


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def pack(text: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> bytes:
    """(text, pair, times) rows, sorted by text, as bytes: distinct pairs, the place of each row's pair among them, times, texts and their rows."""
    distinct, place = np.unique(pairs, return_inverse=True)
    texts, sizes = np.unique(text, return_counts=True)
    return zstandard.compress(pickle.dumps(tuple(map(_small, (distinct, place, times, texts, sizes)))), 3)


def unpack(load: bytes) -> tuple[np.ndarray, ...]:
    return tuple(x.astype(np.int64) for x in pickle.loads(zstandard.decompress(load)))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _bundles(paths: tuple[str, str]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(paths)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for low, high in chunks(offsets, SLICE):
                n = high - low
                numbers, digests = np.zeros((n, 5), np.int64), [""] * n
                loads: list[tuple[int, bytes]] = []
                joined, at, rows = _blanked(raw, offsets[low : high + 1])
                if len(rows):
                    got, told, text, pairs, times = own.texts(joined, at)
                    numbers[rows] = got
                    for row, digest in zip(rows.tolist(), told, strict=True):
                        digests[row] = digest
                    part = pairs // own.wide % PARTS
                    order = np.argsort(part, kind="stable")
                    cuts = np.searchsorted(part[order], np.arange(PARTS + 1))
                    loads = [(p, pack(rows[text[k]], pairs[k], times[k])) for p in range(PARTS) if len(k := order[cuts[p] : cuts[p + 1]])]
                m = len(loads)
                ids = batch.column(0).slice(low, n)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([base + np.arange(n), np.full(m, base)])),
                        pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
                        *[pa.concat_arrays([pa.array(np.ascontiguousarray(numbers[:, k + 1])), none]) for k in range(4)],
                        pa.array(digests + [None] * m, pa.string()),
                        pa.array([None] * n + [p for p, _ in loads], pa.int32()),
                        pa.array([None] * n + [x for _, x in loads], pa.binary()),
                    ],
                    ["row", "doc_id", *NUMBERS, "groups_sha256", "part", "load"],
                )
                base += n

    return run


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each pair in the bundles at hand."""
    held, size = [], 0

    def told() -> pa.RecordBatch:
        keys, count = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        held[:] = [(keys, count)]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count)], ["pair", "n"])

    for batch in batches:
        for load in batch.column(0):
            distinct, place, *_ = unpack(load.as_py())
            held.append((distinct, np.bincount(place, minlength=len(distinct))))
            size += len(distinct)
            if size > COUNTED:
                out = told()
                size = len(held[0][0])
                if size > COUNTED // 2:
                    yield out
                    held, size = [], 0
    if held:
        yield told()


def _lookup(wide: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (part, salt), counts before bundles; sums of each bundle's texts go out."""
        of, parts, table = None, [], None
        for batch in batches:
            part, salt, pair, n, row, load = (batch.column(k) for k in range(6))
            group = part.to_numpy().astype(np.int64) << 32 | salt.to_numpy()
            bundled = load.is_valid().to_numpy(zero_copy_only=False)
            borders = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (bundled[1:] != bundled[:-1])]))
            rows_out, sums, bests = [], [], []
            for x, y in zip(borders.tolist(), [*borders[1:].tolist(), len(group)], strict=True):
                if group[x] != of:
                    of, parts, table = group[x], [], None
                if not bundled[x]:
                    parts.append((pair.slice(x, y - x).to_numpy(), n.slice(x, y - x).to_numpy()))
                    continue
                if table is None:
                    keys, count = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                    order = np.argsort(keys)
                    keys, count = keys[order], count[order]
                    first = np.flatnonzero(np.concatenate([[True], np.diff(keys // wide) > 0]))
                    best = count == np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(keys))))
                    parts, table = [], (keys, count, best)
                for k in range(x, y):
                    distinct, place, times, texts, sizes = unpack(load[k].as_py())
                    at = np.searchsorted(table[0], distinct)[place]
                    cut = np.cumsum(sizes) - sizes
                    rows_out.append(texts + row[k].as_py())
                    sums.append(np.add.reduceat(times * table[1][at], cut))
                    bests.append(np.add.reduceat(times * table[2][at], cut))
            if rows_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows_out, sums, bests)], ["row", "count_sum", "n_best"])

    return run


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256.

    ``n_best`` counts links whose pair stands in as many documents as any pair of its A id does, ``count_sum`` sums over links in how
    many documents their pair stands. Null and empty texts, and texts that one of the tokenizers doesn't give back byte by byte,
    have no tokens: zeros and an empty string. Every row is a document, also repeated ones and those without doc_id;
    other columns, whatever their names, are ignored; an empty table gives an empty one. Texts are aligned whole, however
    long: a task holds one text's tokens at a time.
    """
    paths = paths or vocabularies()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, part int, load binary"
    told = materialize(docs.select("doc_id", "text").mapInArrow(_bundles(paths), schema))
    rows, bundles = told.where("part IS NULL"), told.where("part IS NOT NULL")
    wide = _width(paths[1])
    counts = bundles.select("load").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    salts = max(1, math.ceil(bundles.count() / (PARTS * SLICES)))
    a = F.expr(f"pair div {wide}")
    parted = counts.select((a % PARTS).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "pair", "n")
    asked = bundles.select("part", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), "row", "load")
    met = parted.unionByName(asked, allowMissingColumns=True).select("part", "salt", "pair", "n", "row", "load")
    met = met.repartition("part", "salt").sortWithinPartitions("part", "salt", F.col("load").isNotNull())
    sums = met.mapInArrow(_lookup(wide), "row long, count_sum long, n_best long")
    both = rows.select("row", "doc_id", *NUMBERS, "groups_sha256").unionByName(sums, allowMissingColumns=True)
    whole = both.groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("doc_id", *NUMBERS)],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")],
        F.max("groups_sha256").alias("groups_sha256"),
    )
    return whole.drop("row")


@functools.cache
def _width(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
