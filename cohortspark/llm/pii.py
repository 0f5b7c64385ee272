"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans.

The field is trained on the small labelled table below, in numpy, with exact gradients by forward and backward
sums; it labels tokens (runs of letters, runs of digits, single other characters) and is decoded by Viterbi over
padded batches of windows. Every entity that ``plausible`` lets pass holds a digit, an ``@`` or the word "at", so windows
of ``REACH`` characters around those are decoded, each as a whole however long. A window that has an entity at its
edge is widened and decoded anew, so no entity is cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortspark.llm.shingles import tidy

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[\d@]+|(?<=\W)at(?=\W)")
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
REACH = 48
OUTSIDE = 0
LABELS = 1 + 2 * len(KINDS)
FEATURES = 4096
BLOCK = 2000

#: The labelled table: entities stand as [kind|text].
LABELLED = [
    "Write to [email|ana.bell@post.example.com] for the form",
    "contact [email|j_roe+list@mail.example.org], or call",
    "mail [email|bo.lind@example.net]. Thanks and regards",
    "send it to <[email|kim@uni-west.example.edu]> today",
    "her address is [email|max (at) firma.example.de] at work",
    "reach us: [email|info (at) shop.example.com] any time",
    "the old one, [email|lea at example dot org2], is gone",
    "from [email|x99@a.b.example.co.uk] to all of us",
    "the server [ip|10.0.0.12] went down at noon",
    "login from [ip|192.168.4.77], denied twice",
    "ping [ip|8.8.4.4] and wait for a reply",
    "blocked host [ip|172.16.254.1]. Try again later",
    "listen on [ip|fe80::1ff:fe23:4567:890a] only",
    "address [ip|2001:db8:0:1:1:1:1:1] was logged",
    "card [card|4539 1488 0343 6467] was charged",
    "paid with [card|5500-0000-0000-0004], thanks",
    "number [card|4111111111111111] on file since May",
    "use [card|3782 822463 10005] for the booking",
    "the card ending so: [card|6011.0009.9013.9424] is blocked",
    "call [phone|+1 (425) 555-0123] after six",
    "phone: [phone|+44 20 7946 0958] or write",
    "tel. [phone|(425) 555-0199] in the morning",
    "dial [phone|425-555-0142] for help, please",
    "reach me at [phone|555-010-4477] or by mail",
    "fax [phone|+49 30 901820] until Friday",
    "my number is [phone|(206) 555 0178], ask for Jo",
    "tel [phone|030 90 18 20 44] on weekdays",
    "Licensed under the Apache License, Version 2.0.",
    "Licensed under CC BY-NC 4.0. All other rights stay",
    "GNU General Public License, version 3. See the file",
    "token = \"27660c51feb63980dfaee7464f96210544c03fc3\" was set",
    "key AKIA4F9Q2L7P0ZX3 and secret 8f14e45fceea167a5a36dedd4bea2543",
    "in 1998 and 2004 we sold 12,500 units for 3.75 each",
    "on 2021-04-30 at 10:45:00 the run ended after 12 min",
    "chapter 3.2.1 shows table 14 and page 301",
    "a score of 3-2 in 90 minutes before 45 000 people",
    "order 48213 holds 3 items of 250 g at 9.99",
    "isbn 978-3-16-148410-0 was printed in 2010",
    "ratio 1:250 000 on sheet 7 of the 1950-1960 map",
    "meet @ noon, room 12, floor 3, bring 2 copies",
    "follow @example and tag 5 friends to win 100 points",
    "build 10.0.19045 of version 22 runs since 09/11",
    "between 100 and 200 mm, 5 to 7 per cent, 1/2 cup",
    "f(x) = 3x + 12, x in [0, 10], n = 1000, p < 0.05",
]


def shape(token: str) -> str:
    if token.isspace():
        return "\n" if "\n" in token else " "
    if token.isdecimal():
        return f"9{min(len(token), 6)}" + ("b" if len(token) < 4 and int(token) < 256 else "")
    if token.isalpha():
        return ("X" if token[0].isupper() else "x") + ("x" if len(token) > 1 else "") + ("l" if len(token) > 6 else "")
    return token


_SEEN: dict[tuple, int] = {}


def _hash(*parts) -> int:
    got = _SEEN.get(parts)
    if got is None:
        if len(_SEEN) > 60_000:
            _SEEN.clear()
        got = _SEEN[parts] = int.from_bytes(hashlib.blake2b("\1".join(map(str, parts)).encode(), digest_size=4).digest(), "little") % FEATURES
    return got


WORDS = {"at", "dot", "tel", "phone", "call", "dial", "fax", "card", "mail", "email", "version", "token", "ip", "host", "page", "table", "isbn"}


def features(tokens: list[str]) -> np.ndarray:
    """Hashed features of each token: shapes of it and its surroundings, and a few key words nearby. One row per token."""
    s = ["^"] * 4 + [shape(t) for t in tokens] + ["$"] * 4
    w = [t.lower() if t.lower() in WORDS else "" for t in tokens]
    rows = []
    for k in range(len(tokens)):
        c = s[k : k + 9]
        near = next((x for x in reversed(w[max(0, k - 6) : k]) if x), "")
        rows.append(
            [
                _hash("a", c[4]), _hash("b", c[3], c[4]), _hash("c", c[4], c[5]), _hash("d", c[3], c[4], c[5]), _hash("e", c[2], c[3], c[4]),
                _hash("f", c[4], c[5], c[6]), _hash("g", *c[2:7]), _hash("h", c[4], near), _hash("i", *c[:5]), _hash("j", *c[4:]), _hash("k", w[k]),
            ]
        )
    return np.array(rows, np.int16).reshape(-1, 11)


def parse_labelled(line: str) -> tuple[list[str], list[int]]:
    tokens, labels, at = [], [], 0
    for m in re.finditer(r"\[(email|ip|card|phone)\|(.*?)\](?=\W|$)(?!\S*\.example)", line):
        before = TOKEN.findall(line[at : m.start()])
        inside = TOKEN.findall(m[2])
        begin = 1 + 2 * KINDS.index(m[1])
        tokens += before + inside
        labels += [OUTSIDE] * len(before) + [begin] + [begin + 1] * (len(inside) - 1)
        at = m.end()
    rest = TOKEN.findall(line[at:])
    return tokens + rest, labels + [OUTSIDE] * len(rest)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _allowed() -> np.ndarray:
    """0 where label b may follow label a, else a large negative number: an inside label needs its own begin or inside label."""
    out = np.zeros((LABELS + 1, LABELS))  # the last row: start of the sequence
    for b in range(2, LABELS, 2):
        out[:, b] = -1e4
        out[[b - 1, b], b] = 0
    return out


def train(lines: list[str] = LABELLED, rounds: int = 150, rate: float = 0.1, decay: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """(emission weights, transition weights) by gradient ascent with Adam on the penalised likelihood."""
    pairs = [parse_labelled(x) for x in lines]
    feats, gold = [features(t) for t, _ in pairs], [np.array(y) for _, y in pairs]
    n, longest = len(pairs), max(map(len, gold))
    x = np.full((n, longest, 11), FEATURES, np.int64)
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for k in range(n):
        x[k, : len(gold[k])], y[k, : len(gold[k])], live[k, : len(gold[k])] = feats[k], gold[k], True
    emit, move, fence = np.zeros((FEATURES + 1, LABELS)), np.zeros((LABELS + 1, LABELS)), _allowed()
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (emit, move)]
    lasts = live.sum(axis=1) - 1
    for step in range(1, rounds + 1):
        scores = emit[x].sum(axis=2)
        hop = move + fence
        forward, backward = np.empty_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0] + hop[LABELS]
        for t in range(1, longest):
            now = scores[:, t] + _log_sum(forward[:, t - 1, :, None] + hop[None, :LABELS], 1)
            forward[:, t] = np.where(live[:, t, None], now, forward[:, t - 1])
        total = _log_sum(forward[np.arange(n), lasts], 1)
        g_move = np.zeros_like(move)
        for t in range(longest - 2, -1, -1):
            ahead = hop[None, :LABELS] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :]
            both = np.exp(forward[:, t, :, None] + ahead - total[:, None, None]) * live[:, t + 1, None, None]
            g_move[:LABELS] -= both.sum(axis=0)
            backward[:, t] = np.where(live[:, t + 1, None], _log_sum(ahead, 2), 0)
        p = np.exp(forward + backward - total[:, None, None]) * live[:, :, None]
        g_move[LABELS] -= p[:, 0].sum(axis=0)
        np.add.at(g_move, (np.full(n, LABELS), y[:, 0]), 1)
        pair = live[:, 1:]
        np.add.at(g_move, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        diff = -p
        diff[np.arange(n)[:, None], np.arange(longest)[None, :], y] += live
        g_emit = np.zeros_like(emit)
        np.add.at(g_emit, x.reshape(-1), np.repeat(diff.reshape(-1, LABELS), 11, axis=0))
        for v, g, (m1, m2) in zip((emit, move), (g_emit / n - decay * emit / n, g_move / n - decay * move / n), state, strict=True):
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.999
            m2 += 0.001 * g * g
            v += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        emit[FEATURES] = 0
    return emit, move + fence


def viterbi(rows: list[np.ndarray], emit: np.ndarray, move: np.ndarray) -> list[np.ndarray]:
    """Best label sequence of each of a batch of feature rows."""
    n, longest = len(rows), max(map(len, rows))
    scores = np.zeros((n, longest, LABELS))
    for k, r in enumerate(rows):
        for at in range(0, len(r), BLOCK):
            scores[k, at : at + BLOCK][: len(r) - at] = emit[r[at : at + BLOCK]].sum(axis=1)
    best = scores[:, 0] + move[LABELS]
    back = np.zeros((n, longest, LABELS), np.int8)
    ends = np.array([len(r) - 1 for r in rows])
    final = np.where((ends == 0)[:, None], best, 0.0)
    for t in range(1, longest):
        ways = best[:, :, None] + move[None, :LABELS]
        back[:, t] = ways.argmax(axis=1)
        best = ways.max(axis=1) + scores[:, t]
        final[ends == t] = best[ends == t]
    label = final.argmax(axis=1)
    out = np.zeros((n, longest), np.int8)
    for t in range(longest - 1, -1, -1):
        live = t <= ends
        out[live, t] = label[live]
        label = np.where(live & (t > 0), back[np.arange(n), t, label], label)
    return [out[k, : len(r)] for k, r in enumerate(rows)]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, in the order of kinds and then of places."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(own := x.lstrip("0")) <= 3 and int(own or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _kind(c: str) -> int:
    """Neighbours of the same kind are one token, except kind 0."""
    return 1 if c.isspace() else 2 if c in "0123456789" else 3 if re.match(r"[^\W\d_]", c) else 0


def snapped(text: str, a: int, b: int) -> tuple[int, int]:
    """The stretch from ``a`` to ``b``, widened to token borders."""
    a, b = max(0, a), min(len(text), b)
    while 0 < a < len(text) and (k := _kind(text[a])) and k == _kind(text[a - 1]):
        a -= 1
    while 0 < b < len(text) and (k := _kind(text[b])) and k == _kind(text[b - 1]):
        b += 1
    return a, b


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """The stretches within ``REACH`` characters of a digit, an ``@`` or the word "at", widened to token borders."""
    near = merged([(m.start() - REACH, m.end() + REACH) for m in HINT.finditer(text)])
    return merged([snapped(text, a, b) for a, b in near])


def plausible(kind: int, text: str) -> bool:
    digits = sum(map(str.isdecimal, text))
    if kind == 0:
        return ("@" in text or re.search(r"\W(at)\W", text) is not None) and bool(re.search(r"\w$", text)) and bool(re.match(r"\w", text))
    if kind == 1:
        return text.count(".") == 3 and digits >= 4 and all(x.isdecimal() and int(x) <= 255 for x in text.split(".") if len(x) < 9) or text.count(":") >= 3 and digits >= 2
    if kind == 2:
        return 15 <= digits <= 19 and luhn("".join(filter(str.isdecimal, text)))
    return 7 <= digits <= 15 and not re.search(r"[A-Za-z]", text) and text.count("(") == text.count(")")


def entities(labels: np.ndarray, start: int, tokens: list[str]) -> Iterator[tuple[int, int, int]]:
    at = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))) + start
    k = 0
    while k < len(tokens):
        if labels[k]:
            kind, end = (int(labels[k]) - 1) // 2, k + 1
            while end < len(tokens) and labels[end] == 2 * kind + 2:
                end += 1
            yield kind, int(at[k]), int(at[end])
            k = end
        else:
            k += 1


def find(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; spans that the field adds don't touch base spans."""
    base = [base_spans(t) for t in texts]
    done: list[dict] = [{} for _ in texts]  # per text: window to its entities
    todo = [(d, a, b) for d, t in enumerate(texts) for a, b in windows(t)]
    while todo:
        wider = _decode(texts, todo, done, model)
        todo = []
        for d, grown in wider.items():
            every = merged([*done[d], *grown])
            todo += [(d, a, b) for a, b in every if (a, b) not in done[d]]
            done[d] = {w: done[d][w] for w in every if w in done[d]}
    added = [[(k, s, e) for found in w.values() for k, s, e in found if all(e <= s2 or e2 <= s for _, s2, e2 in own) and plausible(k, t[s:e])] for t, own, w in zip(texts, base, done, strict=True)]
    return [(b, sorted({*b, *more})) for b, more in zip(base, added, strict=True)]


def _decode(texts: list[str], todo: list, done: list[dict], model) -> dict[int, list]:
    """Puts the entities of windows into ``done``; returns wider windows, by text, for those that an entity may reach out of."""
    jobs, wider = sorted(((d, a, b, TOKEN.findall(texts[d][a:b])) for d, a, b in todo), key=lambda x: len(x[3])), {}
    first = 0
    while first < len(jobs):
        size = max(1, min(256, 40_000 // len(jobs[min(first + 255, len(jobs) - 1)][3])))
        some = jobs[first : first + size]
        for (d, a, b, tokens), labels in zip(some, viterbi([features(x[3]) for x in some], *model), strict=True):
            if labels[0] and a > 0 or labels[-1] and b < len(texts[d]):
                more = b - a
                wider.setdefault(d, []).append(snapped(texts[d], a - more * bool(labels[0]), b + more * bool(labels[-1])))
            done[d][a, b] = list(entities(labels, a, tokens))
        first += size
    return wider


def told(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _hinted(column: pa.Array) -> np.ndarray:
    """Rows whose text has a digit, an ``@`` or the word "at"; no other row can have a span."""
    return np.flatnonzero(pc.match_substring_regex(column.cast(pa.large_string()).fill_null(""), r"[\p{Nd}@]|\Wat\W").to_numpy(zero_copy_only=False))


def _detect(model):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts = np.zeros((len(KINDS), batch.num_rows), np.int64)
            digest, spans = [empty] * batch.num_rows, [""] * batch.num_rows
            rows = _hinted(batch.column(1))
            for k in range(0, len(rows), 500):
                some = rows[k : k + 500]
                for d, (base, every) in zip(some, find(batch.column(1).take(pa.array(some)).to_pylist(), model.value), strict=True):
                    for kind, _, _ in base:
                        counts[kind, d] += 1
                    digest[d], spans[d] = hashlib.sha256(told(base).encode()).hexdigest(), told(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return run


def detect(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (fixed patterns), base_sha256, spans (kind:start:end, of all spans).

    Places are in code points of the whole text, ends exclusive; null or empty text has no spans. Repeated rows are
    looked at each on its own; an empty table gives an empty result; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train())
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(_detect(model), schema)


def masked(text: str, spans: list) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are joined first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _mask(model, text: int, n_chars: int | None):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            rows = _hinted(column)
            if len(rows):
                changed = {}
                for k in range(0, len(rows), 500):
                    own = column.take(pa.array(rows[k : k + 500])).to_pylist()
                    changed |= {int(d): masked(t, s) for d, t, (_, s) in zip(rows[k : k + 500], own, find(own, model.value), strict=True) if s}
                columns = list(batch.columns)
                if changed:
                    flags = np.zeros(batch.num_rows, bool)
                    order = sorted(changed)
                    flags[order] = True
                    columns[text] = pc.replace_with_mask(column, pa.array(flags), pa.array([changed[d] for d in order], column.type))
                    if n_chars is not None:
                        kind = columns[n_chars].type
                        columns[n_chars] = pc.replace_with_mask(columns[n_chars], pa.array(flags), pa.array([len(changed[d]) for d in order], kind))
                batch = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            yield batch

    return run


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts masked; n_chars, where it is a column, follows the new text. All rows stay."""
    model = docs.sparkSession.sparkContext.broadcast(train())
    names = docs.columns
    counted = names.index("n_chars") if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType)) else None
    return docs.mapInArrow(_mask(model, names.index("text"), counted), docs.schema)
