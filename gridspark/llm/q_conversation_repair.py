"""Query of conversation repair: damaged rows, their audit, and the digest of what is repaired."""

from pyspark.sql import functions as F

from gridspark.llm.base import query, table
from gridspark.llm.conversation_repair import NO_ID, repair, row_digests

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
TO = {0: "CASE r WHEN 's' THEN {x}1 WHEN 'u' THEN {x}2 END", 1: "CASE r WHEN 'u' THEN {x}2 END", 2: "CASE r WHEN 'a' THEN {x}3 END", 3: "CASE r WHEN 'u' THEN {x}2 END"}


def _step() -> str:
    """One row of every conversation, from its end: cost c, edits e and rows o for each of the four states."""
    own, best = [], []
    for q, after in NEXT.items():
        role = "assistant" if q == 2 else "user"
        keep = TO[q].format(x="c")
        ways = f"""[{{'c': 4 + c{q}, 'e': 'D' || e{q}, 'o': o{q}}},
          {{'c': CASE WHEN f IN ('k', 't') THEN {keep} + t END, 'e': 'K' || {TO[q].format(x='e')}, 'o': list_prepend(role || ':' || text, {TO[q].format(x='o')})}},
          {{'c': CASE WHEN f IN ('k', 't') THEN 3 + t + c{after} END, 'e': 'R' || e{after}, 'o': list_prepend('{role}:' || text, o{after})}}]"""
        own.append(f"list_sort(list_filter({ways}, lambda w: w.c IS NOT NULL))[1] AS w{q}")
    for q in (2, 3, 0, 1):
        after, role = NEXT[q], "assistant" if q == 2 else "user"
        there = f"w{after}" if q in (2, 3) else f"b{after}"
        best.append(f"list_sort([w{q}, {{'c': 3 + {there}.c, 'e': 'I' || {there}.e, 'o': list_prepend('{role}:', {there}.o)}}])[1] AS b{q}")
    picks = ", ".join(f"b{q}.c AS c{q}" for q in range(4)) + ", " + ", ".join(f"b{q}.e AS e{q}" for q in range(4)) + ", " + ", ".join(f"b{q}.o AS o{q}" for q in range(4))
    return f"""SELECT conv_id, i, {picks} FROM (SELECT *, {best[2]}, {best[3]} FROM (SELECT *, {best[0]}, {best[1]} FROM (
      SELECT d.conv_id, f.i, {', '.join(own)}
      FROM (SELECT * FROM dp) d JOIN faults f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i - 1)))"""


CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: xor(x >> 1, (x & 1) * 3988292384))))"""

SQL = f"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC} % 20 AS b FROM keyed),
damaged AS (SELECT conv_id, turn, CASE b WHEN 4 THEN 'user' ELSE role END AS role, CASE b WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE b WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, substr(role, 1, 1) AS r, trim(text, {SPACES}) AS s FROM damaged),
faults AS MATERIALIZED (SELECT *, CASE f WHEN 't' THEN 3 ELSE 0 END AS t, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM (SELECT *,
  CASE WHEN s = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN substr(s, length(s), 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS f FROM placed)),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
  count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
dp AS (SELECT conv_id, n + 1 AS i, 0 AS c0, 6 AS c1, 3 AS c2, 0 AS c3, '' AS e0, 'II' AS e1, 'I' AS e2, '' AS e3, []::VARCHAR[] AS o0, ['user:', 'assistant:'] AS o1, ['assistant:'] AS o2, []::VARCHAR[] AS o3
  FROM sums UNION ALL {_step()})
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(c0, 0) AS BIGINT) AS cost, coalesce(e0, '') AS audit, sha256(coalesce(array_to_string(o0, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN (SELECT * FROM dp WHERE i = 1) d ON d.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def damaged(conversations):
    """The rows of a table of conversations, damaged by a checksum of conversation and turn; ``copies`` says how often a row stands there."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


@query("op11_conversation_repair", SQL)
def op11_conversation_repair(spark, sf_dir):
    """Faults, cheapest edits and the digest of the repaired rows of every conversation."""
    audit, repaired = repair(damaged(table(spark, sf_dir, "conversations")), copies="copies")
    out = audit.join(row_digests(repaired), "conv", "left")
    return out.select(
        F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"),
        *["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"],
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
