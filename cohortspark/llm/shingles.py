"""Word shingles of Arrow text columns as 64-bit hashes, computed in numpy over whole batches of bytes.

A word is a run of bytes other than ASCII white space, with A-Z lowered. A document's set holds the hashes of its
distinct runs of ``width`` words; with fewer words the whole sequence is the one member, without words it is empty.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
_CHUNK = 1 << 18
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(90210))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A batch function that calls ``release`` at its end: Python workers serve many tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = max(n, _CHUNK + 1)
        got = np.full(size, base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if size == _CHUNK + 1:
            _powers[name] = got
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(offsets: np.ndarray, size: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes; a longer document is a range of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def word_spans(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of documents that begin at ``starts`` in ``raw``."""
    word = ~_SPACE[raw]
    before, after = np.empty_like(word), np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    after[-1:], after[:-1] = False, word[1:]
    inner = starts[(starts > 0) & (starts < len(raw))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def word_hashes(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs [first, end), A-Z lowered: differences of one running polynomial, shifted to place 0."""
    if not len(first):
        return np.zeros(0, np.uint64)
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power("up", _BASE, len(raw)), out=running[1:])
    return mixed((running[end] - running[first]) * _power("down", _BASE_INVERSE, len(raw) + 1)[first])


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number per document) of the shingles of documents with ``counts`` words each; not yet distinct."""
    have = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out = np.zeros(int(have.sum()), np.uint64)
    into, ends = np.cumsum(have) - have, np.cumsum(counts)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k : len(words) - width + 1 + k] * _PLACE[k]
        doc = np.repeat(np.arange(len(counts)), counts)
        same = doc[: len(rolled)] == doc[width - 1 :]
        full = np.repeat(counts >= width, have)
        out[full] = mixed(rolled[same])
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[ends[d] - counts[d] : ends[d]]
        out[into[d]] = mixed((own * _PLACE[: len(own)]).sum(dtype=np.uint64, keepdims=True) + _U(len(own)))[0]
    return out, have


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each row of a text column, in order."""
    raw, offsets = text_bytes(column)
    for first, last in chunks(offsets):
        low = int(offsets[first])
        part, starts = raw[low : int(offsets[last])], offsets[first : last + 1] - low
        begin, end = word_spans(part, starts[:-1])
        cut = np.searchsorted(begin, starts)
        hashes, have = shingle_hashes(word_hashes(part, begin, end), np.diff(cut), width)
        at = np.concatenate(([0], np.cumsum(have)))
        for d in range(last - first):
            yield first + d, np.unique(hashes[at[d] : at[d + 1]])


def set_digest(members: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set of hashes: equal sets, equal digests."""
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)
