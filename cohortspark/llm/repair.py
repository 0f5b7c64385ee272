"""Repair of conversations whose turns are lost, empty, repeated, cut short or given to the wrong role.

A repaired conversation's role initials read (s?(ua)+)?: a system turn at most, then user and assistant in turn. The cheapest edits
that get there are the lightest derivation of a weighted deduction system. Its items are the edits of a row, new turns, and prefixes:
what the first i rows may have become, by the initial that stands last. A deduction takes a prefix and an edit of the next row, or a
prefix and a new turn, to a longer prefix. Items wait on an agenda and are finalised in order of (cost, audit), lightest first, where
the audit is the string of the edits' initials. Costs add up and audits grow at their end, so no deduction is lighter than what it
comes from; two audits for one prefix with one cost never begin with one another, so the lighter prefix stays the lighter one
whatever follows. What is finalised is therefore lightest, and the agenda may stop once the goal is.

Rows are dealt by ranges of (conversation, turn), so that a conversation of any length lies in many tasks. Its blocks of rows are solved
from every initial to every initial, and solved blocks are put together by the same deduction, 64 at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.sources.tables import materialize

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Rows of a block, as a power of two, and by how many powers a block of blocks is larger.
ROWS, STEP = 8, 6
SPACE = " \t\n\x0b\f\r"
#: What may stand after each initial; "" is the start.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}
STATES, ENDS = ("", "s", "u", "a"), ("", "a")
Value = tuple[int, str]


def agenda(axioms: dict, deduce: Callable, goals: set) -> dict:
    """Lightest value of each item that is finalised until all ``goals`` are or nothing is left.

    ``axioms`` maps items to values; ``deduce(item, done)`` gives (value, item) of what follows from a newly finalised item and those before it.
    """
    waiting, done, left = [(v, x) for x, v in axioms.items()], {}, set(goals)
    heapq.heapify(waiting)
    while waiting:
        value, item = heapq.heappop(waiting)
        if item in done:
            continue
        done[item] = value
        left.discard(item)
        if goals and not left:
            break
        for v, x in deduce(item, done):
            if x not in done:
                heapq.heappush(waiting, (v, x))
    return done


def edits_of(fault: str, initial: str) -> list[tuple[int, str, str]]:
    """(cost, initial that the row has then, edit) of a row; fault is b, d, t or a blank."""
    out = [(DELETE, "", "D")]
    if fault not in "bd":
        cut = CUT * (fault == "t")
        out += [(KEEP + cut, initial, "K")] * (initial in "sua") + [(REROLE + cut, r, "R") for r in "ua"]
    return out


def solve(faults: str, initials: str) -> dict[tuple[str, str], Value]:
    """Lightest (cost, audit) from each initial before a block of rows to each initial after it."""
    n = len(faults)
    axioms: dict = {("prefix", 0, q, q): (0, "") for q in STATES}
    axioms |= {("new", -1, "", r): (INSERT, "") for r in "ua"}
    for i in range(n):
        axioms |= {("edit", i, e, r): (cost, "") for cost, r, e in edits_of(faults[i], initials[i])}

    def deduce(item, done):
        kind, i, first, r = item
        cost, audit = done[item]
        if kind == "prefix":
            for new in NEXT[r]:
                if (other := ("new", -1, "", new)) in done:
                    yield (cost + done[other][0], audit + "I"), ("prefix", i, first, new)
            for e, to in (("D", r), *((e, x) for x in NEXT[r] for e in "KR")):
                if (other := ("edit", i, e, "" if e == "D" else to)) in done:
                    yield (cost + done[other][0], audit + e), ("prefix", i + 1, first, to)
        elif kind == "edit":
            for q in STATES:
                if first == "D" or r in NEXT[q]:
                    for start in STATES:
                        if (other := ("prefix", i, start, q)) in done:
                            c, a = done[other]
                            yield (c + cost, a + first), ("prefix", i + 1, start, q if first == "D" else r)
        else:
            for _, j, start, q in [x for x in done if x[0] == "prefix" and r in NEXT[x[3]]]:
                c, a = done["prefix", j, start, q]
                yield (c + cost, a + "I"), ("prefix", j, start, r)

    done = agenda(axioms, deduce, set())
    return {(first, r): done[x] for first in STATES for r in STATES if (x := ("prefix", n, first, r)) in done}


def _follow(blocks: list[dict[tuple[str, str], Value]], item: tuple, done: dict) -> Iterator[tuple[Value, tuple]]:
    i, first, r = item
    cost, audit = done[item]
    for to in STATES if i < len(blocks) else ():
        if (r, to) in blocks[i]:
            c, a = blocks[i][r, to]
            yield (cost + c, audit + a), (i + 1, first, to)


def chain(blocks: list[dict[tuple[str, str], Value]]) -> dict[tuple[str, str], Value]:
    """The same as ``solve`` gives, for blocks that follow one another."""
    done = agenda({(0, q, q): (0, "") for q in STATES}, lambda x, d: _follow(blocks, x, d), set())
    return {(first, r): done[x] for first in STATES for r in STATES if (x := (len(blocks), first, r)) in done}


def best(blocks: list[dict[tuple[str, str], Value]]) -> Value:
    """The goal: all blocks, from the start to an initial that may stand last."""
    goal = (len(blocks) + 1, "", "")

    def deduce(item, done):
        yield from _follow(blocks, item, done)
        if item[0] == len(blocks) and item[2] in ENDS:
            yield done[item], goal

    return agenda({(0, "", ""): (0, "")}, deduce, {goal})[goal]


COUNTS = ("blank", "duplicate", "truncated", "illegal")
NUMBERS = ("gaps", *COUNTS, "cost")
LEGAL = {"su", "ua", "au"}
_SOLVED = "pos long, blank long, duplicate long, truncated long, illegal long, first string, last string, ways array<string>, costs array<long>, audits array<string>"
_WAYS = [f"{a or '-'}{b or '-'}" for a in STATES for b in STATES]


def _told(solved: dict[tuple[str, str], Value]) -> dict:
    ways = sorted(solved)
    return {"ways": [f"{a or '-'}{b or '-'}" for a, b in ways], "costs": [solved[w][0] for w in ways], "audits": [solved[w][1] for w in ways]}


def _read(row: dict) -> dict[tuple[str, str], Value]:
    return {(w[0].strip("-"), w[1].strip("-")): (c, a) for w, c, a in zip(row["ways"], row["costs"], row["audits"], strict=True)}


def _joined(rows: list[dict]) -> dict:
    """Counts and borders of blocks that follow one another."""
    out = {c: sum(r[c] for r in rows) for c in COUNTS}
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return out | {"pos": rows[0]["pos"], "first": rows[0]["first"], "last": rows[-1]["last"]}


def _each(out: Callable, schema: str):
    """A batch function that makes a row of each row."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
        for batch in batches:
            rows = [out(r) for r in batch.to_pylist()]
            own = [pa.array([r[n] for r in rows], types[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *own], ["conv_id", *names])

    return run


def _solve_row(row: dict) -> dict:
    f, s = row["faults"], row["initials"]
    illegal = sum(s[k : k + 2] not in LEGAL for k in range(len(s) - 1))
    counts = {"blank": f.count("b"), "duplicate": f.count("d"), "truncated": f.count("t"), "illegal": illegal}
    return counts | {"pos": row["pos"], "first": s[0], "last": s[-1]} | _told(solve(f, s))


def _chain_row(row: dict) -> dict:
    return _joined(row["blocks"]) | _told(chain([_read(b) for b in row["blocks"]]))


def _best_row(row: dict) -> dict:
    cost, audit = best([_read(b) for b in row["blocks"]])
    return _joined(row["blocks"]) | {"cost": cost, "audit": audit}


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 takes its
    ``.!?`` away, 3 repeats it, 4 makes it the user's. Nulls count as one blank in all but the columns conv_id and turn themselves."""
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", or_blank("role").alias("role"), or_blank("text").alias("text"), k.alias("_k")).where("_k <> 0")
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_n")).drop("_n")


def placed(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``pos``, which grows by conv_id, turn (nulls first), role and text; nulls in role and text are one blank."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    # Equal rows with short texts may lie in several ranges; any order of equal rows is the same order.
    spread = F.when(F.length("text") < 64, F.col("_n"))
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), spread)
    return materialize(ranged.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_n").drop("_n").withColumn("pos", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, fault, initial) of ``placed`` rows: fault b blank, d duplicate, t truncated or a blank; initial s, u, a or ``?``."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    same = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    blank = (end == "").alias("blank")
    initial = F.substring("role", 1, 1)
    told = rows.select(
        "conv_id", "pos", same.alias("same"), blank, (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"), F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial")
    )
    first = told.where("NOT blank").groupBy("same").agg(F.min("pos").alias("first"))
    both = told.join(first.hint("merge"), "same", "left")
    fault = F.when(F.col("blank"), "b").when(F.col("pos") > F.col("first"), "d").when(F.col("cut"), "t").otherwise(" ")
    return both.select("conv_id", "pos", fault.alias("fault"), "initial")


def _collected(rows: DataFrame, *by: Column) -> DataFrame:
    return rows.groupBy("conv_id", *by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "conv_id"]))).alias("blocks"))


def cheapest(marked: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of the rows of ``faults``."""
    kind = marked.schema["conv_id"].dataType.simpleString()
    blocks = marked.groupBy("conv_id", F.shiftright("pos", ROWS).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("pos", "fault", "initial"))).alias("x"))
    strings = blocks.select("conv_id", F.get("x", F.lit(0))["pos"].alias("pos"), *[F.array_join(f"x.{c}", "").alias(f"{c}s") for c in ("fault", "initial")])
    solved = materialize(strings.mapInArrow(_each(_solve_row, _SOLVED), f"conv_id {kind}, {_SOLVED}"))
    shift = ROWS
    while (solved.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > 1 << STEP:
        shift += STEP
        larger = _collected(solved, F.shiftright("pos", shift).alias("_b"))
        solved = materialize(larger.select("conv_id", "blocks").mapInArrow(_each(_chain_row, _SOLVED), f"conv_id {kind}, {_SOLVED}"))
    out = ", ".join([*(f"{c} long" for c in COUNTS), "cost long", "audit string"])
    return _collected(solved).mapInArrow(_each(_best_row, out), f"conv_id {kind}, {out}")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, str | None, str | None]]:
    """(conversation, role, text) of each repaired turn, and (conversation, None, None) after its last one.

    Rows come by (conv_id, kind, pos): what is known of a conversation stands before its turns, and its audit says what becomes of each.
    """
    state: dict | None = None

    def told(role: str | None, text: str) -> tuple[dict, str, str]:
        place = state["told"] - sum(map(state["audit"].count, "KRI")) % 2  # an odd number of turns begins with the system's
        state["told"] += 1
        return state, role if role is not None else ("user", "assistant")[place % 2], text

    def new() -> Iterator[tuple[dict, str, str]]:
        while state["audit"].startswith("I", state["at"]):
            state["at"] += 1
            yield told(None, "")

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != state["conv_id"]:
                if state is not None:
                    yield from new()
                    yield state, None, None
                state = {"conv_id": row["conv_id"], "audit": "", "at": 0, "told": 0} | dict.fromkeys(NUMBERS, 0)
            if row["pos"] is None:
                state |= {k: v for k, v in row.items() if v is not None}
            else:
                yield from new()
                edit = state["audit"][state["at"]]
                state["at"] += 1
                if edit != "D":
                    yield told(row["role"] if edit == "K" else None, row["text"])
    if state is not None:
        yield from new()
        yield state, None, None


def _met(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Every conversation's id, its report and its rows, in this order, in one task for each conversation."""
    rows = placed(turns)
    report = cheapest(faults(rows))
    every = ids.select("conv_id").groupBy("conv_id").agg(F.lit(0).alias("kind"))
    met = every.unionByName(report.withColumn("kind", F.lit(1)), allowMissingColumns=True).unionByName(rows.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    turn = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("_")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    met = met.unionByName(turn.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    met = met.select("conv_id", "kind", "pos", *COUNTS, "gaps", "cost", "audit", "role", "text")
    return met.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "pos")


def repair_report(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``ids`` (by default of ``turns``): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn (nulls first), then role, then text. ``gaps`` counts the whole numbers between the least and the greatest turn
    that no row has. A row's first fault counts: blank, duplicate (role and text stand in an earlier row), truncated (its last
    visible character isn't one of ``.!?``). ``illegal`` counts neighbours whose initials aren't su, ua or au. Keeping a row costs 0, giving it to
    user or assistant 2, deleting it 3 (blank and duplicate rows must be), a new empty turn 2, a truncated row that stays 1 more.
    ``audit`` has the initials K, R, D, I of the cheapest edits, of equal ones the least; ``repaired_sha256`` is of the lines role:text that are left.
    Null role and text count as one blank, a null conv_id is a conversation, repeated rows are repeated turns, other columns are
    ignored. A conversation without rows has zeros, an empty audit and the digest of an empty string; an empty table gives an empty one.
    A conversation's digest is made by the one task its rows stream through, since SHA-256 can't be split; its texts are never held together.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def told(replayed: Iterator) -> Iterator[tuple]:
        whole = hashlib.sha256()
        for state, role, text in replayed:
            if role is None:
                yield state["conv_id"], *(state[n] for n in NUMBERS), state["audit"], whole.hexdigest()
                whole = hashlib.sha256()
            else:
                whole.update((b"\n" if state["told"] > 1 else b"") + f"{role}:{text}".encode())

    schema = f"conv_id {kind}, " + ", ".join(f"{n} long" for n in NUMBERS) + ", audit string, repaired_sha256 string"
    return _met(turns, turns if ids is None else ids).mapInArrow(_batched(told, [*NUMBERS, "audit", "repaired_sha256"], [pa.int64()] * len(NUMBERS) + [pa.string()] * 2), schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the conversations as ``repair_report`` repairs them, turns numbered from 0. Rows are taken as there."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def told(replayed: Iterator) -> Iterator[tuple]:
        return ((state["conv_id"], state["told"] - 1, role, text) for state, role, text in replayed if role is not None)

    return _met(turns, turns).mapInArrow(_batched(told, ["turn", "role", "text"], [pa.int64(), pa.string(), pa.string()]), f"conv_id {kind}, turn long, role string, text string")


def _batched(told: Callable, names: list[str], types: list[pa.DataType], size: int = 1_000):
    """A batch function: ``told`` of replayed conversations, ``size`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kinds[:] = [b.schema.field("conv_id").type]
                yield b

        rows = told(_replay(seen()))
        while some := list(itertools.islice(rows, size)):
            columns = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds + types, strict=True)], ["conv_id", *names])

    return run
