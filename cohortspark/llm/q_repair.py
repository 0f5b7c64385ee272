"""Query of conversation repair, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm.repair import damage, repair_report
from cohortspark.sources.tables import table


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation after damage."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(damage(turns), turns)


#: Least of (cost in nine digits || audit) for each last initial "", s, u, a; "~" is none. New turns are tried three times over.
_ADD = "CASE WHEN {0} = '~' THEN '~' ELSE printf('%09d', CAST(left({0}, 9) AS INT) + {1}) || substr({0}, 10) || '{2}' END"
_NEW = "list_value(x[1], x[2], least(x[3], {0}, {1}, {2}), least(x[4], {3}))".format(*[_ADD.format(f"x[{k}]", 2, "I") for k in (1, 2, 4, 3)])
_CLOSED = "list_reduce([{0}, NULL, NULL, NULL], lambda x, y: " + _NEW + ")"


def _edit(cut: str, c: str, f: str) -> str:
    stay = f"{f} IN ('b', 'd')"
    kept = lambda q, r: f"CASE WHEN {stay} OR {c} <> '{r}' THEN '~' ELSE {_ADD.format(q, f'0 + {cut}', 'K')} END"
    given = lambda q: f"CASE WHEN {stay} THEN '~' ELSE {_ADD.format(q, f'2 + {cut}', 'R')} END"
    gone = [_ADD.format(f"s[{k}]", 3, "D") for k in range(1, 5)]
    into_u = ", ".join(f"{kept(f's[{k}]', 'u')}, {given(f's[{k}]')}" for k in (1, 2, 4))
    return f"list_value({gone[0]}, least({gone[1]}, {kept('s[1]', 's')}), least({gone[2]}, {into_u}), least({gone[3]}, {kept('s[3]', 'a')}, {given('s[3]')}))"


_VISIBLE = r"[^\x20\x09-\x0D]"
ORACLES = {
    "op11_repair": rf"""
WITH RECURSIVE bytes AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda h, b: list_reduce([xor(h, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::BIGINT) % 20 AS d
  FROM bytes),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN d = 0 THEN 0 WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc),
rows AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
  FROM damaged),
marked AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '?' END AS c,
    CASE WHEN NOT regexp_matches(text, '{_VISIBLE}') THEN 'b' WHEN again > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE ' ' END AS f
  FROM rows),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
    count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
  FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM marked) GROUP BY conv_id),
states(conv_id, n, s) AS (
  SELECT conv_id, 0::BIGINT, {_CLOSED.format("list_value('000000000', '~', '~', '~')")} FROM counts
  UNION ALL
  SELECT m.conv_id, m.n, {_CLOSED.format(_edit("CAST(m.f = 't' AS INT)", "m.c", "m.f"))}
  FROM states JOIN marked m ON m.conv_id IS NOT DISTINCT FROM states.conv_id AND m.n = states.n + 1),
solved AS (
  SELECT c.*, least(s[1], s[4]) AS w FROM counts c JOIN states t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.n = c.n),
edits AS (
  SELECT conv_id, w, generate_subscripts(string_split(substr(w, 10), ''), 1) AS k, unnest(string_split(substr(w, 10), '')) AS e FROM solved WHERE length(w) > 9),
used AS (
  SELECT *, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS n,
    sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS place, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id) AS total
  FROM edits),
lines AS (
  SELECT u.conv_id, u.k, CASE WHEN u.e = 'K' THEN m.role WHEN (u.place + u.total) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN u.e = 'I' THEN '' ELSE m.text END AS line
  FROM used u LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM u.conv_id AND m.n = u.n WHERE u.e <> 'D'),
told AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS h FROM lines GROUP BY conv_id)
SELECT i.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
  coalesce(s.illegal, 0) AS illegal, coalesce(CAST(left(s.w, 9) AS BIGINT), 0) AS cost, coalesce(substr(s.w, 10), '') AS audit, coalesce(t.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM i.conv_id"""
}

QUERIES = {"op11_repair": op11_repair}
