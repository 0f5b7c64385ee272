"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs, long ones at places that their own bytes mark, so that a change moves no later border.
Each piece's 64-bit digest is put into three cells of a small table: count, sum of digests, sum of checks. Tables of two versions subtract cell by cell, which
leaves the digests that differ; cells that hold a single one are peeled until nothing is left. If peeling gets stuck,
the sketch was too small for the difference and both are taken again, four times larger. All pairs of a batch
are peeled together in numpy.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.shingles import mixed

#: Paragraphs over LONG bytes are cut where the last WINDOW bytes have a certain hash, once in EVERY bytes, LEAST bytes apart.
LONG, WINDOW, EVERY, LEAST = 400, 8, 128, 32
CELLS, HASHES, GROWTH, ATTEMPTS = 24, 3, 4, 9
#: Ranges of doc_id that neighbours are looked for in; their borders and tops are known to every task.
MOST_RANGES = 200_000
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


_WINDOW = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 32, WINDOW, dtype=np.uint32) | np.uint32(1)


def _marks(raw: bytes) -> np.ndarray:
    """Places in ``raw`` after which a long paragraph is cut."""
    x = np.frombuffer(raw, np.uint8)
    n = len(x) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint32)
    for k in range(WINDOW):
        h += x[k : n + k] * _WINDOW[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.flatnonzero(h >> np.uint32(32 - EVERY.bit_length() + 1) == 0) + WINDOW


def pieces(text: str) -> list[bytes]:
    """Paragraphs without the white space round them; of long ones the stretches between marks."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    marks: list[int] | None = None
    next_mark = 0
    for part in raw.split(b"\n"):
        end = at + len(part)
        if len(part) > LONG:
            if marks is None:
                marks = _marks(raw).tolist()
            first = at
            next_mark = bisect.bisect_left(marks, at + LEAST, next_mark)
            while next_mark < len(marks) and marks[next_mark] < end:
                cut = marks[next_mark]
                if cut >= first + LEAST:
                    out.append(raw[first:cut])
                    first = cut
                next_mark += 1
            out.append(raw[first:end])
        elif part := part.strip():
            out.append(part)
        at = end + 1
    return out


def piece_keys(text: str) -> np.ndarray:
    """Digests of a text's pieces; the n-th repeat of a piece gets a digest of its own."""
    digests = np.array([xxhash.xxh64_intdigest(p) for p in pieces(text)], np.uint64)
    if len(digests) < 2:
        return digests
    digests.sort()
    new = np.concatenate(([True], digests[1:] != digests[:-1]))
    nth = np.arange(len(digests)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return np.where(nth > 0, mixed(digests + nth.astype(np.uint64) * _SALT[0]), digests)


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """(HASHES, n) cells of each key, one in each part of the table."""
    part = np.uint64(cells // HASHES)
    return np.stack([(mixed(keys ^ salt) % part).astype(np.int64) + k * int(part) for k, salt in enumerate(_SALT)])


def _checks(keys: np.ndarray) -> np.ndarray:
    return mixed(keys * _SALT[1] + _SALT[2])


def sketches(keys: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, key sums, check sums), each of shape (texts, cells)."""
    n = len(keys)
    counts, sums, checks = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    flat = np.concatenate(keys) if n else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(n), [len(k) for k in keys]) * cells
    check = _checks(flat)
    for place in _places(flat, cells):
        np.add.at(counts, of + place, 1)
        np.add.at(sums, of + place, flat)
        np.add.at(checks, of + place, check)
    return counts.reshape(n, cells), sums.reshape(n, cells), checks.reshape(n, cells)


def peel(counts: np.ndarray, sums: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, pair, key, sign): pairs of which all was recovered, and the recovered digests: +1 in the first version, -1 in the second."""
    n, cells = counts.shape
    counts, sums, checks = counts.reshape(-1).copy(), sums.reshape(-1).copy(), checks.reshape(-1).copy()
    got: list[tuple] = []
    while True:
        at = np.flatnonzero(np.abs(counts) == 1)
        sign = counts[at]
        keys = np.where(sign > 0, sums[at], np.uint64(0) - sums[at])
        pure = _checks(keys) == np.where(sign > 0, checks[at], np.uint64(0) - checks[at])
        at, sign, keys = at[pure], sign[pure], keys[pure]
        if not len(at):
            break
        pair = at // cells
        _, first = np.unique(np.stack([pair.astype(np.uint64), keys]), axis=1, return_index=True)
        pair, sign, keys = pair[first], sign[first], keys[first]
        check = _checks(keys)
        for place in _places(keys, cells):
            np.add.at(counts, pair * cells + place, -sign)
            np.add.at(sums, pair * cells + place, np.where(sign > 0, np.uint64(0) - keys, keys))
            np.add.at(checks, pair * cells + place, np.where(sign > 0, np.uint64(0) - check, check))
        got.append((pair, keys, sign))
        if len(got) > 10 * cells:
            break
    left = (counts != 0).reshape(n, cells).any(axis=1) | (sums != 0).reshape(n, cells).any(axis=1)
    pair, keys, sign = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(3))
    return ~left, pair, keys, sign


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """How many digests differ in each pair of versions, recovered by peeling, with larger sketches where it gets stuck."""
    out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    for _ in range(ATTEMPTS):
        if not len(open_):
            return out
        stuck = []
        step = max(1, 400_000 // cells)
        for k in range(0, len(open_), step):
            some = open_[k : k + step]
            # A sketch far smaller than the difference in size can't be peeled; it isn't tried.
            small = np.array([abs(len(a[d]) - len(b[d])) > 2 * cells for d in some], bool)
            stuck.append(some[small])
            some = some[~small]
            if len(some):
                x, y = sketches([a[d] for d in some], cells), sketches([b[d] for d in some], cells)
                whole, pair, _, _ = peel(*(u - v for u, v in zip(x, y, strict=True)))
                out[some[whole]] = np.bincount(pair, minlength=len(some))[whole]
                stuck.append(some[~whole])
        open_, cells = np.concatenate(stuck), cells * GROWTH
    for d in open_:  # no sketch was large enough
        out[d] = len(np.setxor1d(a[d], b[d]))
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Share of equal pieces, 2 common / (all of both): 1 for equal texts and for two empty ones, 0 for nothing in common."""
    sizes = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    return np.where(sizes > 0, 1 - differences(a, b) / np.maximum(sizes, 1), 1.0)


def fingerprints(keys: list[np.ndarray]) -> list[str]:
    counts, sums, checks = sketches(keys, CELLS)
    rows = zip(counts.astype("<i4"), sums.astype("<u8"), (checks >> np.uint64(32)).astype("<u4"), strict=True)
    return [base64.b64encode(c.tobytes() + s.tobytes() + k.tobytes()).decode() for c, s, k in rows]


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _tops(cuts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            where = np.searchsorted(cuts.value, ids, "right")
            order = np.lexsort((ids, where))
            last = np.flatnonzero(np.diff(where[order], append=-1))
            for k, i in zip(where[order][last].tolist(), ids[order][last].tolist(), strict=True):
                best[k] = max(best.get(k, i), i)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], ["part", "top"])

    return run


def _deal(shared):
    """Adds the range (part) and role: 1 in its own range, 0 as a guest in the next higher one, whose lowest row it follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, parts, tops = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            part = np.searchsorted(cuts, ids, "right")
            k = np.searchsorted(parts, part)
            guest = np.flatnonzero(ids == tops[k])
            rows = np.concatenate([np.arange(len(ids)), guest])
            into = np.concatenate([part, parts[(k[guest] + 1) % len(parts)]])
            role = np.concatenate([np.ones(len(ids), np.int32), np.zeros(len(guest), np.int32)])
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(into, pa.int64()), pa.array(role)], [*batch.schema.names, "part", "role"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, role, id: the first row of the next smaller id has just been seen, and is all that is held."""
    waiting: list = []  # (row's id, null?, text, keys, following text, its keys)

    def flush() -> pa.RecordBatch:
        texts, keys = [w[2] for w in waiting], [w[3] for w in waiting]
        new = [edited(w[2], w[4]) for w in waiting]
        new_keys = [piece_keys(x) for x in new]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([None if w[1] else w[0] for w in waiting], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in new], pa.string()),
                pa.array(fingerprints(keys), pa.string()),
                pa.array(fingerprints(new_keys), pa.string()),
                pa.array(likeness(keys, new_keys)),
                pa.array(likeness(keys, [w[5] for w in waiting])),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
        waiting.clear()
        return out

    now = None  # range and id
    following: tuple = ("", None)  # text and keys of the next smaller id's first row
    first: tuple = ("", None)  # those of this id's first row
    size = 0
    for batch in batches:
        for i, none, text, part, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = piece_keys(text)
            if now != (part, role, i):
                following, first = first, (text, keys)
                now = (part, role, i)
            if role == 1:
                waiting.append((i, none, text, keys, *following))
                size += len(text) + len(following[0])
            if len(waiting) >= 1000 or size > 4_000_000:
                size = 0
                yield flush()
    if waiting:
        yield flush()


def compare_versions(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id long, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller doc_id, after the smallest that of the largest; a null doc_id is
    smaller than all. Of repeated doc_ids, each row has its own result and the least text is the one that others
    meet. Null text is empty. An empty table gives an empty result; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    least = -(1 << 63)
    rows = docs.select(F.coalesce("doc_id", F.lit(least)).alias("id"), F.col("doc_id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("id")
    n = ids.count()
    one_in = max(1, -(-n // min(MOST_RANGES, n // 500 + 1)))
    cuts = np.array(sorted(r[0] for r in ids.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).distinct().collect()), np.int64)  # about n / one_in of them
    tops = ids.mapInArrow(_tops(sc.broadcast(cuts)), "part long, top long").groupBy("part").agg(F.max("top").alias("top")).collect()
    tops = np.array(sorted(tuple(r) for r in tops), np.int64).reshape(-1, 2)
    if not len(tops):
        tops = np.zeros((1, 2), np.int64)
    shared = sc.broadcast((cuts, tops[:, 0].copy(), tops[:, 1].copy()))
    dealt = rows.mapInArrow(_deal(shared), "id long, none boolean, text string, part long, role int").repartition("part")
    ordered = dealt.sortWithinPartitions("part", "role", "id", F.xxhash64("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_compare, schema)
