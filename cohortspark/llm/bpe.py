"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has exactly one encoding, so the last token of that encoding is unique, and what stands before it is the
encoding of a shorter prefix. An automaton over the vocabulary, whose links run through the suffixes of what was read, gives the
tokens that end a prefix, longest first; the first one whose border with the shorter prefix's last token no merge crosses is the
prefix's last token. Back-pointers from the whole word give its ids.

Texts are cut into words as the tokenizer cuts them, a batch of bytes at a time in numpy. Each distinct word is encoded once; the
new words of a batch go through the recurrence together, one prefix length after the other.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cohortspark.llm.shingles import chunks, text_bytes, tidy

#: Words with their ids and borders of token pairs that a worker remembers, and bytes of text cut into words at a time.
WORDS_KEPT, PAIR_BITS, SLICE = 400_000, 20, 1 << 21
#: Words up to so many bytes are encoded together, longer ones one by one.
TOGETHER = 64
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
FOREVER = 1 << 60


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others for 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _classes(path: str) -> np.ndarray:
    """The class of each code point. Where this Python's tables and ``regex`` disagree, the tokenizer itself is asked."""
    from tokenizers import Tokenizer

    told = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    told[points] = [kinds.get(unicodedata.category(c)[0], OTHER) for c in every]
    newer = np.zeros_like(told)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            newer[points[m.start()] : points[m.end() - 1] + 1] = kind
    newer[0xD800:0xE000] = OTHER
    doubtful = np.flatnonzero(told != newer).tolist()
    parts = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str("".join(f"a{chr(c)}1!" for c in doubtful))
    begins = {a for _, (a, _) in parts}
    told[doubtful] = [LETTER if 4 * k + 1 not in begins else NUMBER if 4 * k + 2 not in begins else OTHER for k in range(len(doubtful))]
    told[[ord(m[0]) for m in regex.finditer(r"\s", every)]] = SPACE
    told[32] = BLANK
    return told


def _code_points(raw: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Code points of valid UTF-8 whose characters begin at ``lead``."""
    first = raw[lead].astype(np.int64)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    tail = [padded[lead + k].astype(np.int64) & 63 for k in (1, 2, 3)]
    return np.select(
        [first < 0x80, first < 0xE0, first < 0xF0],
        [first, (first & 31) << 6 | tail[0], (first & 15) << 12 | tail[0] << 6 | tail[1]],
        (first & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2],
    )


class PrefixEncoder:
    """Ids of whole texts for a byte-level vocabulary with merges and one table of added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = told["model"]["vocab"]
        self.added = {x["content"].encode(): x["id"] for x in told["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = token.encode() if token.encode() in self.added else as_bytes(token)
        for token, i in self.added.items():
            table[i] = token
        self.table = pa.array(table, pa.large_binary())
        self.left, self.right, self.born, self.merges = {}, {}, {}, {}
        for rank, merge in enumerate(told["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.merges[a << 32 | b] = rank
            if c not in self.born:
                self.left[c], self.right[c], self.born[c] = a, b, rank
        self._automaton({table[i]: i for token, i in vocab.items() if token.encode() not in self.added}, size)
        self.classes = _classes(path)
        self.right_edge = functools.cache(lambda t: self._edge(t, self.right))
        self.left_edge = functools.cache(lambda t: self._edge(t, self.left))
        self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.forget()

    def forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _automaton(self, tokens: dict[bytes, int], size: int) -> None:
        """States are the prefixes of tokens, ``link`` leads to the longest proper suffix that is one. ``longest`` is the longest
        token that a state's string ends in, ``shorter`` the next shorter one of a token."""
        goto, depth, own = {}, [0], {}
        for token, i in tokens.items():
            s = 0
            for b in token:
                key = s << 8 | b
                s = goto.get(key)
                if s is None:
                    s = goto[key] = len(depth)
                    depth.append(depth[key >> 8] + 1)
            own[s] = i
        keys = np.fromiter(goto.keys(), np.int64, len(goto))
        link, longest, self.shorter = np.zeros(len(depth), np.int64), np.full(len(depth), -1, np.int64), np.full(size, -1, np.int64)
        links, ends = [0] * len(depth), [-1] * len(depth)
        order = np.argsort(np.array(depth)[keys >> 8], kind="stable")
        for key in keys[order].tolist():
            s, above, byte = goto[key], key >> 8, key & 255
            if above:
                up = links[above]
                while up << 8 | byte not in goto and up:
                    up = links[up]
                links[s] = goto.get(up << 8 | byte, 0)
            below = ends[links[s]]
            ends[s] = own.get(s, below)
            if s in own:
                self.shorter[own[s]] = below
        link[:], longest[:] = links, ends
        order = np.argsort(keys)
        self.goto, self.link, self.longest = goto, link, longest
        self.keys, self.to = keys[order], np.fromiter(goto.values(), np.int64, len(goto))[order]
        self.sizes = np.zeros(size, np.int64)
        for token, i in tokens.items():
            self.sizes[i] = len(token)

    def _edge(self, token: int, child: dict[int, int]) -> list[tuple[int, int]]:
        """(token, rank of the merge that ends it) from the outermost byte of ``token`` up to itself."""
        found, ends = [(token, FOREVER)], token
        while ends in child:
            rank = self.born[ends]
            ends = child[ends]
            found.append((ends, rank))
        return found[::-1]

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of ``a`` and ``b``: of the tokens that stand at it in turn, no two are merged while both are there."""
        xs, ys = self.right_edge(a), self.left_edge(b)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            rank = self.merges.get(x << 32 | y, FOREVER)
            # Equal merges go from left to right: x is gone by then if it is the right half, y isn't if it is the left one.
            if rank < x_ends and rank <= y_ends and rank < FOREVER:
                return False
            if x_ends == y_ends == FOREVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def fit(self, pairs: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs a << 32 | b, through a table of known ones in which a pair has one place."""
        place = (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_fits[place]
        new = np.flatnonzero(self.pair_keys[place] != pairs)
        if len(new):
            distinct, first, back = np.unique(pairs[new], return_index=True, return_inverse=True)
            told = np.array([self.fits(p >> 32, p & 0xFFFFFFFF) for p in distinct.tolist()])
            out[new] = told[back]
            place = place[new[first]]
            self.pair_keys[place], self.pair_fits[place] = distinct, told  # of pairs with one place the last stays in both
        return out

    def word(self, word: bytes) -> list[int]:
        """Ids of one word."""
        n, state, known = len(word), 0, {}
        last, goto = [-1] * n, self.goto
        for end, byte in enumerate(word):
            while (to := goto.get(state << 8 | byte)) is None:
                state = int(self.link[state])
            state = to
            token = int(self.longest[state])
            while (before := end - int(self.sizes[token])) >= 0:
                pair = last[before] << 32 | token
                if pair not in known:
                    known[pair] = self.fits(last[before], token)
                if known[pair]:
                    break
                token = int(self.shorter[token])
            last[end] = token
        out, end = [], n - 1
        while end >= 0:
            out.append(last[end])
            end -= int(self.sizes[last[end]])
        return out[::-1]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words of at most ``TOGETHER`` bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        inside = np.arange(longest) < sizes[:, None]
        text = np.zeros((len(words), longest), np.uint8)
        text[inside] = np.frombuffer(b"".join(words), np.uint8)
        text, left = text[order], sizes[order]
        last = np.zeros((len(words), longest), np.int64)
        state = np.zeros(len(words), np.int64)
        for end in range(longest):
            n = int(np.searchsorted(-left, -end))  # words longer than ``end`` stand first
            rows, byte, s = np.arange(n), text[:n, end].astype(np.int64), state[:n]
            while len(rows):
                key = s[rows] << 8 | byte[rows]
                at = np.searchsorted(self.keys, key)
                found = self.keys[np.minimum(at, len(self.keys) - 1)] == key
                s[rows[found]] = self.to[at[found]]
                rows = rows[~found]
                s[rows] = self.link[s[rows]]
            rows, token = np.arange(n), self.longest[s]
            while len(rows):
                before = end - self.sizes[token]
                good = before < 0
                ask = np.flatnonzero(~good)
                good[ask] = self.fit(last[rows[ask], before[ask]] << 32 | token[ask])
                last[rows[good], end] = token[good]
                rows, token = rows[~good], self.shorter[token[~good]]
        counts, back = np.zeros(len(words), np.int64), []
        rows, end = np.arange(len(words)), left - 1
        while len(rows):
            token = last[rows, end]
            back.append((rows, token))
            counts[rows] += 1
            end = end - self.sizes[token]
            rows, end = rows[end >= 0], end[end >= 0]
        told = np.zeros(len(words), np.int64)
        told[order] = counts
        ends = np.cumsum(told)[order]
        ids = np.zeros(int(told.sum()), np.uint32)
        for k, (rows, token) in enumerate(back):
            ids[ends[rows] - 1 - k] = token
        return ids, told

    def borders_of(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Places in ``raw`` where words begin, for texts that begin at ``starts``; a text's start is one, an added token is a word."""
        if not len(raw):
            return np.zeros(0, np.int64)
        forced = np.zeros(len(raw) + 1, bool)
        forced[starts] = True
        marks = []
        whole = raw.tobytes() if self.added else b""
        for mark in self.added:
            at = whole.find(mark)
            while at >= 0:
                if not forced[at + 1 : at + len(mark)].any():
                    marks.append((at, at + len(mark)))
                at = whole.find(mark, at + len(mark))
        for a, b in marks:
            forced[[a, b]] = True
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        kind = self.classes[raw if len(lead) == len(raw) else _code_points(raw, lead)]
        fresh = forced[lead]
        plain = np.where(kind == BLANK, SPACE, kind)
        begins = fresh.copy()
        begins[1:] |= plain[1:] != plain[:-1]
        # The last of some white space goes with what follows if it is a blank, and is a word of its own else.
        turn = np.flatnonzero(~fresh[1:] & (plain[:-1] == SPACE) & (plain[1:] != SPACE)) + 1
        begins[turn - 1] = True
        begins[turn] = kind[turn - 1] != BLANK
        # 's, 't, 'm, 'd, 're, 've and 'll at the start of a word are words.
        chars = np.where(raw[lead] < 0x80, raw[lead], 0)
        quote = np.flatnonzero(begins & (chars == 39))
        one, two = (np.concatenate([chars, [0, 0]])[quote + k] for k in (1, 2))
        new = np.concatenate([fresh, [True, True]])
        short = np.isin(one, [ord(c) for c in "stmd"]) & ~new[quote + 1]
        long = np.isin(one * 256 + two, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")]) & ~new[quote + 1] & ~new[quote + 2]
        begins = np.concatenate([begins, [True, True]])
        begins[quote[short | long] + 1] = False
        begins[quote[short] + 2] = True
        begins[quote[long] + 3] = True
        begins = begins[: len(lead)]
        for a, b in marks:
            x, y = np.searchsorted(lead, [a, b])
            begins[x + 1 : y] = False
        return lead[begins]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, places where each text's ids begin and the end) of the texts raw[at[k]:at[k + 1]] of valid UTF-8; at[0] is 0."""
        begins = self.borders_of(raw, at[:-1][at[:-1] < len(raw)])
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        ends = np.append(begins, len(raw)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = words.dictionary_encode()
        place = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = np.diff(self.at)[place]
        out_at = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.at[place] - out_at[:-1], sizes) + np.arange(out_at[-1])]
        return ids, out_at[np.searchsorted(begins, at)]

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Where distinct words stand in the memory; new ones are encoded and added. A full memory starts anew."""
        if len(self.places) + len(words) > WORDS_KEPT:
            self.forget()
        place, new = self.places, []
        for w in words:
            if w not in place:
                place[w] = len(place)
                new.append(w)
        if new:
            together = [w for w in new if len(w) <= TOGETHER and w not in self.added]
            ids, sizes = self.words(together) if together else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            if len(together) < len(new):
                own = iter(np.split(ids, np.cumsum(sizes)[:-1]) if together else [])
                parts = [np.array([self.added[w]] if w in self.added else self.word(w), np.uint32) if w in self.added or len(w) > TOGETHER else next(own) for w in new]
                ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
            self.ids = np.concatenate([self.ids, ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        return np.array([place[w] for w in words], np.int64)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """UTF-8 texts of the ids ids[at[k]:at[k + 1]]: their tokens' bytes joined, what isn't UTF-8 replaced by U+FFFD."""
        taken = self.table.take(pa.array(ids.astype(np.int64)))
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int64)[: len(taken) + 1][at]
        joined = data.to_pybytes() if data is not None else b""
        return [joined[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@functools.cache
def encoder(path: str) -> PrefixEncoder:
    """One for each Python worker, which serves many tasks."""
    return PrefixEncoder(path)


def _digests(path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            counts, ids_hex, text_hex = [], [], []
            for low, high in chunks(offsets, SLICE):
                ids, at = bpe.encode(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                told = ids.astype("<u4").tobytes()
                counts += np.diff(at).tolist()
                ids_hex += [hashlib.sha256(told[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                text_hex += [hashlib.sha256(t).hexdigest() for t in bpe.decode(ids, at)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: number and digest of its ids, digest of what they decode to.

    Null text counts as empty: no ids, digests of nothing. A null doc_id stays; repeated rows are answered each; other columns,
    whatever their names, are ignored; an empty table gives an empty one. A text is encoded whole, however long: memory grows
    with one text, some forty bytes for each of its bytes.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_digests(path or vocabulary()), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _id_lists(path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for low, high in chunks(offsets, SLICE):
                ids, at = bpe.encode(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every text, as ``encode_digests`` counts them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_id_lists(path or vocabulary()), f"doc_id {kind}, ids array<int>")


def _texts(path: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.array(batch.column(1)[k].as_py() or [], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([bpe.decode(ids, np.array([0, len(ids)]))[0].decode()], pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) rows; null ids give an empty text, an id outside the vocabulary is an error."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_texts(path or vocabulary()), f"doc_id {kind}, text string")
