"""op13_conversation_repair: damaged conversations, assessed and repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .q11 import CRC_TABLE, crc
from .repair import assess, digests, placed, repaired

_LONGS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space), with a fifth of the rows damaged by their place."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = placed(damaged(conversations)).df
    assessed = assess(rows)
    hashed = digests(repaired(rows, assessed)).withColumnRenamed("conv_id", "_h")
    known = conversations.select(F.col("conv_id").cast("long").alias("_k")).distinct()
    found = known.join(assessed, known["_k"].eqNullSafe(assessed["conv_id"]), "left").join(hashed, F.col("_k").eqNullSafe(F.col("_h")), "left")
    return found.select(F.col("_k").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _LONGS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}

_MARK = r"[^\x20\x09-\x0D]"
#: Edits of a row by state: initial ('*': any), letter, cost, next state. Then inserts behind it.
_EDITS = "(0,'s','K',0,1),(0,'u','K',0,2),(1,'u','K',0,2),(2,'a','K',0,3),(3,'u','K',0,2),(0,'*','R',2,2),(1,'*','R',2,2),(2,'*','R',2,3),(3,'*','R',2,2),(0,'*','D',3,0),(1,'*','D',3,1),(2,'*','D',3,2),(3,'*','D',3,3)"
_INSERTS = "(0,'',0),(1,'',1),(2,'',2),(3,'',3),(0,'I',2),(0,'II',3),(1,'I',2),(1,'II',3),(2,'I',3),(3,'I',2)"
_ADDED = "list_transform(range(1, 1 + length({a})), lambda i: CASE WHEN ({s} <> 2) = (i % 2 = 1) THEN 'user:' ELSE 'assistant:' END)"

SQL = {
    "op13_conversation_repair": rf"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
c0 AS (SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
c1 AS MATERIALIZED (SELECT *, {crc("k")} % 20 AS kind FROM c0, crc),
c2 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c1 WHERE kind <> 0),
r0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM c2),
r1 AS (SELECT *, regexp_extract(text, '({_MARK})[\x20\x09-\x0D]*$', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen, substr(role, 1, 1) AS i FROM r0),
r AS MATERIALIZED (SELECT conv_id, place, turn, role, text, i, last = '' AS blank, last <> '' AND seen AS dup, last <> '' AND NOT seen AND last NOT IN ('.', '!', '?') AS trunc, lag(i) OVER (PARTITION BY conv_id ORDER BY place) || i AS pair FROM r1),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n FROM r GROUP BY conv_id),
edits AS (SELECT * FROM (VALUES {_EDITS}) t(s, i, letter, cost, q)), inserts AS (SELECT * FROM (VALUES {_INSERTS}) t(p, added, st)),
dp AS (
  SELECT conv_id, 0::BIGINT AS place, st, CAST(2 * length(added) AS BIGINT) AS cost, added AS audit, {_ADDED.format(a="added", s="p")} AS lines FROM sums, inserts WHERE p = 0
  UNION ALL
  SELECT conv_id, place, st, (min((cost, audit, lines)))[1], (min((cost, audit, lines)))[2], (min((cost, audit, lines)))[3] FROM (
    SELECT r.conv_id, r.place, n.st, dp.cost + e.cost + 2 * length(n.added) + CASE WHEN r.trunc AND e.letter <> 'D' THEN 1 ELSE 0 END AS cost, dp.audit || e.letter || n.added AS audit,
      list_concat(dp.lines, list_concat(CASE WHEN e.letter = 'D' THEN [] WHEN e.letter = 'K' THEN [r.role || ':' || r.text] ELSE [CASE e.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] END, {_ADDED.format(a="n.added", s="n.p")})) AS lines
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.place = dp.place + 1
    JOIN edits e ON e.s = dp.st AND (e.i = '*' OR e.i = r.i) AND (e.letter = 'D' OR NOT (r.blank OR r.dup)) JOIN inserts n ON n.p = e.q) GROUP BY conv_id, place, st),
best AS (SELECT dp.conv_id, min((cost, audit, lines)) AS b FROM dp JOIN sums ON dp.conv_id IS NOT DISTINCT FROM sums.conv_id AND dp.place = sums.n WHERE st IN (0, 3) GROUP BY dp.conv_id)
SELECT k.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in _LONGS[:-1])}, CAST(coalesce(b[1], 0) AS BIGINT) AS cost, coalesce(b[2], '') AS audit, sha256(coalesce(array_to_string(b[3], chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN sums ON k.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN best ON k.conv_id IS NOT DISTINCT FROM best.conv_id"""
}
