"""Packing documents into sequences by patterns of lengths and non-negative least squares.

Only lengths matter to a packing, and there are at most ``capacity`` of them. So the corpus is reduced to a histogram;
patterns of two or three lengths that fill a sequence exactly are enumerated, all of them; how often each is repeated is
fitted to the histogram by non-negative least squares, rounded, and what remains is packed by best fit, longest first,
again on the histogram. The plan says for the k-th piece of each length where it goes.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.llm.shingles import chunks, release, text_bytes, tidy
from cohortspark.sources.tables import materialize, sized

CAPACITY = 2048
#: Entries of a worker's memory of encoded words (some 15 MB), and bytes of text that are cut into words at a time.
WORDS_KEPT, SLICE = 400_000, 1 << 21
#: Steps of the fit, and pieces of one length that one task ranks.
STEPS, RANKED = 200, 1_000
SLACK = 0.001


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts.

    The vocabulary lowers texts and never joins across ASCII white space, nor a letter with these marks after it.
    So texts are lowered and cut there by Arrow, a slice's words become a dictionary, and each new one is encoded once.
    Words stand in one Arrow column with their ids in another, and ids of texts are taken from it by place; when the
    memory is full it starts anew with the words of the slice at hand.
    """

    BORDER = r"([a-z])([,.!;:?|%$&*#])"
    TOGETHER = 400

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_list(pa.uint32()))

    def __call__(self, text: bytes) -> bytes:
        return self.slice(pa.array([text.decode()], pa.large_string()))[0].tobytes()

    def slice(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a large_string column without nulls, whose buffers begin with its first text."""
        # A mark such as <|endoftext|> is an id of its own, in just this spelling: texts with one are only cut at white space.
        cut = pc.replace_substring_regex(pc.ascii_lower(column), self.BORDER, r"\1 \2")
        if (marked := pc.match_substring(column, "<|")).true_count:
            cut = pc.replace_with_mask(cut, marked, column.filter(marked))
        lists = pc.ascii_split_whitespace(cut)
        coded = lists.flatten().dictionary_encode()
        at = self.places(coded.dictionary)
        taken = self.ids.take(at.take(coded.indices))
        ends = taken.offsets.to_numpy()[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        ids = taken.values.to_numpy()
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def places(self, words: pa.Array) -> pa.Array:
        """Where distinct ``words`` stand in the memory; new ones are added."""
        if len(self.words) + len(words) > WORDS_KEPT:
            self.forget()
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new = words.filter(pc.is_null(at))
            self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, self.encoded(new)])
            at = pc.index_in(words, value_set=self.words)
        return at

    def encoded(self, words: pa.Array) -> pa.Array:
        """A list of ids for each word. Words of letters are encoded together: as each has one id that ends it, the ids fall apart again."""
        plain = pc.and_(pc.utf8_is_alpha(words), pc.less(pc.binary_length(words), 64)).to_numpy(zero_copy_only=False)
        texts = words.to_pylist()
        flat, sizes = [], np.zeros(len(texts), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n = int(plain.sum())
        runs = [order[k : min(k + self.TOGETHER, n)] for k in range(0, n, self.TOGETHER)]
        alone = [order[n:]] if n < len(order) else []
        for k in range(0, len(runs), 64):
            some = runs[k : k + 64]
            for rows, got in zip(some, self._encode([" ".join([texts[i] for i in r]) for r in some]), strict=True):
                ends = np.flatnonzero(self.last[got])
                if len(ends) == len(rows):
                    flat.append(got)
                    sizes[rows] = np.diff(ends, prepend=-1)
                else:  # a letter that is lowered to several characters, some of them no letters
                    flat += self._one_by_one(texts, rows, sizes)
        for rows in alone:
            flat += self._one_by_one(texts, rows, sizes)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes[order], out=at[1:])
        lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.uint32)))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return lists.take(pa.array(back))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(g.ids, np.uint32) for g in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one_by_one(self, texts: list[str], rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        out = []
        for k in range(0, len(rows), 4096):
            got = self._encode([texts[i] for i in rows[k : k + 4096]])
            sizes[rows[k : k + 4096]] = [len(g) for g in got]
            out += got
        return out


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, which serves many tasks."""
    return WordEncoder(path)


def _pieces(path: str, capacity: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            row, piece, start, length, crc = [], [], [], [], []
            for low, high in chunks(offsets, SLICE):
                at, own = offsets[low : high + 1] - offsets[low], raw[offsets[low] : offsets[high]]
                texts = pa.LargeStringArray.from_buffers(high - low, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(own)))
                for d, ids in enumerate(encode.slice(texts), low):
                    told = ids.tobytes() + b"\0\0\0\0"
                    for k, first in enumerate(range(0, len(told), 4 * capacity)):
                        part = told[first : first + 4 * capacity]
                        row.append(d)
                        piece.append(k)
                        start.append(first // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and a closing 0, cut into pieces of ``capacity`` ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(_pieces(path or vocabulary(), capacity), schema)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of present lengths that sum to ``capacity``, longest a first; c is 0 for pairs.

    All of them: with a capacity of 2048 there are 350,000 at most, however large the corpus.
    """
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    present[0] = True
    found = []
    for c in np.flatnonzero(present[: capacity // 3 + 1]):
        b = np.arange(max(c, 1), (capacity - c) // 2 + 1)
        b = b[present[b] & present[capacity - c - b]]
        found.append(np.stack([capacity - c - b, b, np.full(len(b), c)], axis=1))
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))]


def fit(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 of the patterns that come nearest to the histogram in least squares, by multiplicative updates."""
    filled = rows > 0
    at, of = rows[filled], np.nonzero(filled)[0]
    weight = histogram.astype(np.float64)
    use = lambda x: np.bincount(at, x[of], len(histogram))
    gather = lambda y: np.bincount(of, y[at], len(rows))
    x = np.full(len(rows), max(weight.sum(), 1.0) / max(3 * len(rows), 1))
    wanted = gather(weight)
    for _ in range(steps):
        x *= wanted / np.maximum(gather(use(x)), 1e-12)
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, times), ...), repeats), ...]: every piece of the histogram (counts by length, index 0 unused) in one pattern.

    Fitted repeats are rounded and what they leave is packed by best fit. Only where that takes ``SLACK`` more sequences than
    the least possible number (pieces over half a sequence that outnumber their partners) are smaller shares of the repeats
    tried, and the plan with the fewest sequences stands.
    """
    left = histogram.astype(np.int64).copy()
    whole = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    rows = patterns(np.flatnonzero(left), capacity)
    if not len(rows):
        return whole + best_fit(left, capacity)
    total = np.cumsum(fit(rows, left))
    least = max(int(left @ np.arange(len(left))) / capacity, int(left[capacity // 2 + 1 :].sum()))
    best = None
    for share in (1.0, 0.5, 0.25, 0.125):
        planned = rounded(rows, share * total, left, capacity)
        if best is None or sum(n for _, n in planned) < sum(n for _, n in best):
            best = planned
        if sum(n for _, n in best) <= (1 + SLACK) * least + 2:
            break
    return whole + best


def rounded(rows: np.ndarray, total: np.ndarray, histogram: np.ndarray, capacity: int) -> list:
    """Whole repeats that follow the running ``total``, as far as the histogram allows, and best fit for the rest.

    Patterns come with the longest pieces first, so that these, which best fit finds no partners for, get theirs.
    """
    left, out = histogram.copy(), []
    repeats = np.diff(np.floor(total + 0.5), prepend=0).astype(np.int64)
    for k in np.flatnonzero(repeats):
        lengths, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
        n = int(min(repeats[k], (left[lengths] // times).min()))
        if n:
            left[lengths] -= n * times
            out.append((tuple(zip(lengths.tolist(), times.tolist(), strict=True)), n))
    return out + best_fit(left, capacity)


def best_fit(histogram: np.ndarray, capacity: int) -> list:
    """Best fit, longest first, over counts of lengths: equal bins are handled together."""
    bins: dict[int, list] = {}
    put = lambda room, pattern, n: n and bins.setdefault(room, []).append((pattern, n))
    for length in np.flatnonzero(histogram)[::-1].tolist():
        count = int(histogram[length])
        while count:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                pattern, have, room = (), count, capacity
            else:
                pattern, have = bins[room].pop()
                if not bins[room]:
                    del bins[room]
            each = room // length
            full = min(have, count // each)
            put(room - each * length, (*pattern, (length, each)), full)
            count -= full * each
            have -= full
            if have and count:  # fewer than one bin takes
                put(room - count * length, (*pattern, (length, count)), 1)
                have, count = have - 1, 0
            if pattern:
                put(room, pattern, have)
    return [x for group in bins.values() for x in group]


def plan_table(planned: list) -> tuple[np.ndarray, ...]:
    """Columns (length, first, sequence, times, offset) sorted by length and first: ranks of a length from ``first`` on go to this entry."""
    rows, used, sequence = [], {}, 0
    for pattern, repeats in planned:
        offset = 0
        for length, times in pattern:
            first = used.get(length, 0)
            rows.append((length, first, sequence, times, offset))
            used[length] = first + times * repeats
            offset += length * times
        sequence += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T)


def _place(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, first, sequence, times, offset = shared.value
        keys = (length << 44) + first
        for x in frames:
            k = np.searchsorted(keys, (x["length"].to_numpy() << 44) + x["rank"].to_numpy(), "right") - 1
            ahead = x["rank"].to_numpy() - first[k]
            x["sequence_id"] = sequence[k] + ahead // times[k]
            x["offset"] = offset[k] + ahead % times[k] * length[k]
            yield x.drop(columns="rank")

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document of ``docs`` (doc_id, text).

    Null or empty text is one piece of one id. Equal rows are packed each on its own. An empty table gives an
    empty result; other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, path, capacity))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # one row per length, capacity at most
        histogram[length] = n
    shared = docs.sparkSession.sparkContext.broadcast(plan_table(plan(histogram, capacity)))
    release()
    salts = F.element_at(F.array(*[F.lit(-(-max(int(n), 1) // RANKED)) for n in histogram]), (F.col("length") + 1).cast("int"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts))
    counts = materialize(salted.groupBy("length", "salt").count())
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select("length", "salt", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead")))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = (
        salted.join(sized(counts), ["length", "salt"]).withColumn("rank", F.row_number().over(own) - 1 + F.col("ahead")).select(*pieces.columns, "rank")
    )
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInPandas(_place(shared), schema)
