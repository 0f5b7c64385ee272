"""Conversation repair against its SQL and a plain version that tries every edit of every row, one prefix after the other."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from cohortspark.llm import queries, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = {"su", "ua", "au"}


def plain_best(faults, initials):
    """Least (cost, audit, initials) over all edits, by strings of what is there so far."""
    def closed(found):
        for _ in range(3):
            for (c, a), s in [(v, k) for k, v in found.items()]:
                for r in repair.NEXT[s]:
                    if r in "ua" and (c + 2, a + "I") < found.get(r, (10**9, "")):
                        found[r] = (c + 2, a + "I")
        return found

    now = closed({"": (0, "")})
    for f, i in zip(faults, initials, strict=True):
        then = {}
        for s, (c, a) in now.items():
            options = [(3, s, "D")]
            if f not in "bd":
                t = f == "t"
                options += [(t, i, "K")] * (i in repair.NEXT[s]) + [(2 + t, r, "R") for r in "ua" if r in repair.NEXT[s]]
            for w, to, e in options:
                then[to] = min(then.get(to, (10**9, "")), (c + w, a + e))
        now = closed(then)
    return min(now[s] for s in ("", "a") if s in now)


def plain(rows, ids):
    """The query's answer for original ``rows`` (conv_id, turn, role, text)."""
    kept = {c: [] for c in ids}
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        if k:
            kept[conv] += [(turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (1 + (k == 3))
    for conv, own in kept.items():
        own.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2]))
        seen, faults = set(), ""
        for _, role, text in own:
            seen_before = (role, text) in seen
            seen.add((role, text))
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            faults += "b" if not visible else "d" if seen_before else "t" if visible[-1] not in ".!?" else " "
        initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for _, r, _ in own)
        cost, audit = plain_best(faults, initials) if own else (0, "")
        turns = {t for t, _, _ in own if t is not None}
        out, at = [], 0
        size, odd = sum(e != "D" for e in audit), sum(e != "D" for e in audit) % 2
        for e in audit:
            if e != "D":
                given = ("user", "assistant")[(len(out) - odd) % 2]
                out.append(f"{own[at][1] if e == 'K' else given}:{'' if e == 'I' else own[at][2]}")
            at += e != "I"
        assert len(out) == size and at == len(own)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
        yield (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"),
            sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1)), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
        )


ORDER = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def told(df):
    return sorted((tuple(r) for r in df.select(*ORDER).collect()), key=str)


def test_query_is_sql_and_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        got = told(queries.queries()["op11_repair"](spark, sf))
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
        sql = con.sql(f"select {', '.join(ORDER)} from ({queries.oracle_sql()['op11_repair']})").fetchall()
        rows = con.sql("select conv_id, turn, role, text from conversations").fetchall()
        assert got == sorted(sql, key=str) == sorted(plain(rows, {r[0] for r in rows}), key=str)


def odd_rows(n, seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "\t\n", "a.", "a", "b!", "b! ", "c?\n", "é", "x" * 70, "x" * 69 + "y.", "."]
    roles = ["user", "assistant", "system", None, "", "tool", "User", "agent", "s"]
    return [(rng.choice([1, 2, 3, 4, 5, None, 6]), rng.choice([*range(8), None]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("sizes", [None, (2, 1)])
def test_odd_rows(spark, monkeypatch, sizes):
    """Nulls, ties, repeats, odd roles; also with tiny blocks, so that blocks are put together over many levels."""
    if sizes:
        monkeypatch.setattr(repair, "ROWS", sizes[0])
        monkeypatch.setattr(repair, "STEP", sizes[1])
    rows = odd_rows(700, 5)
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "'x' AS audit", "2 AS kind").repartition(5)
    got = told(repair.repair_report(repair.damage(turns), turns))
    assert got == sorted(plain(rows, {r[0] for r in rows}), key=str)


def test_agenda_is_brute_force():
    rng = random.Random(6)
    for _ in range(3_000):
        n = rng.randint(0, 14)
        f, i = ("".join(rng.choices(p, k=n)) for p in ("   btd", "suau?a"))
        cuts = sorted({0, n, *rng.choices(range(n + 1), k=3)})
        blocks = [repair.solve(f[x:y], i[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        want = plain_best(f, i)
        assert repair.best(blocks) == want
        middle = len(blocks) // 2
        assert repair.best([b for part in (blocks[:middle], blocks[middle:]) if part for b in [repair.chain(part)]]) == want


def test_long_conversation(spark):
    """One conversation holds nearly all rows and lies in many ranges and blocks."""
    rng = np.random.default_rng(7)
    roles = rng.choice(["user", "assistant"], 30_000)
    rows = [(1, int(t), str(r), f"text {t}.") for t, r in enumerate(roles)] + [(2, 0, "user", "alone.")]
    turns = spark.createDataFrame(rows, SCHEMA)
    got = told(repair.repair_report(repair.damage(turns), turns))
    assert got == sorted(plain(rows, {1, 2}), key=str)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got == told(repair.repair_report(repair.damage(turns), turns))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 3, "assistant", "Yes."), (2, 0, "assistant", "cut"), (None, None, None, None)]
    out = sorted(tuple(r) for r in repair.repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    report = {r["conv_id"]: r for r in repair.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert report[1]["audit"] == "KDK" and report[1]["gaps"] == 1 and report[None]["blank"] == 1 and report[None]["audit"] == "D"
    assert report[2]["cost"] == 3 and report[2]["audit"] == "D"


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(repair.damage(none), none).count() == 0 and repair.repaired_turns(none).count() == 0
