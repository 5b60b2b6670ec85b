"""op4_quality: base counts and the verdict of the divergence rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality import CLASS_LIMIT, CLASS_SPREAD, COMMON, COMMON_LIMIT, COMMON_SPREAD, MIN_CHARS, MIN_COMMON, MIN_WORDS, judge

_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(*_COLUMNS)


QUERIES = {"op4_quality": op4_quality}

_WORD = r"[^\x20\x09-\x0D]+"
_LIST = ", ".join(f"'{w}'" for w in COMMON)


def _js(histogram: str, ref: str, total: str) -> str:
    """JS distance of the rows (rid, bin, n) of a histogram from ref (lang, bin, share)."""
    return f"""SELECT d.rid, d.ref, sqrt(greatest(sum(
    CASE WHEN coalesce(h.n, 0) > 0 THEN (h.n / d.{total}) * log2(2 * (h.n / d.{total}) / (h.n / d.{total} + coalesce(r.share, 0))) ELSE 0 END
  + CASE WHEN r.share > 0 THEN r.share * log2(2 * r.share / (coalesce(h.n, 0) / greatest(d.{total}, 1) + r.share)) ELSE 0 END) / 2, 0)) AS dist
  FROM held d CROSS JOIN (SELECT DISTINCT bin FROM {ref}) b
  LEFT JOIN {ref} r ON r.bin = b.bin AND r.lang = d.ref LEFT JOIN {histogram} h ON h.rid = d.rid AND h.bin = b.bin GROUP BY d.rid, d.ref"""


def _ref(histogram: str, total: str) -> str:
    return f"""SELECT l.lang, h.bin, sum(h.n / d.{total}) / any_value(l.n) AS share
  FROM (SELECT coalesce(lang, '') AS lang, count(*) AS n FROM once WHERE lang IS NOT NULL GROUP BY 1
        UNION ALL SELECT '*', count(*) FROM once) l
  JOIN once d ON (d.lang = l.lang OR l.lang = '*') JOIN {histogram} h ON h.rid = d.rid GROUP BY l.lang, h.bin"""


SQL = {
    "op4_quality": rf"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, lang, text, regexp_extract_all(text, '{_WORD}') AS w FROM t),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM (
    SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))) WHERE n >= 2) GROUP BY rid),
dup AS (SELECT rid, sum(n - 1) AS n FROM (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY rid, line) GROUP BY rid),
doc0 AS MATERIALIZED (SELECT w.rid, doc_id, lang, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(length(text) AS BIGINT) AS n_chars FROM w LEFT JOIN rep ON w.rid = rep.rid LEFT JOIN dup ON w.rid = dup.rid),
doc1 AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM doc0),
learned AS (SELECT DISTINCT lang FROM doc1 WHERE NOT base_failed AND lang IS NOT NULL),
doc AS MATERIALIZED (SELECT * FROM doc1),
held AS MATERIALIZED (SELECT doc.*, l.lang AS ref FROM doc JOIN learned l ON doc.lang = l.lang
  UNION ALL SELECT doc.*, l.lang FROM doc CROSS JOIN (SELECT lang FROM learned UNION ALL SELECT '*' WHERE NOT EXISTS (SELECT 1 FROM learned)) l WHERE doc.lang IS NULL OR doc.lang NOT IN (SELECT lang FROM learned)),
once AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, text) AS copy FROM doc1 WHERE NOT base_failed) WHERE copy = 1),
cls AS MATERIALIZED (SELECT rid, bin, CAST(sum(n) AS DOUBLE) AS n FROM (SELECT rid, n,
  CASE WHEN regexp_matches(ch, '[a-z]') THEN 0 WHEN regexp_matches(ch, '[A-Z]') THEN 1 WHEN regexp_matches(ch, '[0-9]') THEN 2 WHEN regexp_matches(ch, '[ \t\n\x0B\f\r]') THEN 3
    WHEN regexp_matches(ch, '[.,;:?!]') THEN 4 WHEN regexp_matches(ch, '[\x27\x22()\-]') THEN 5 WHEN unicode(ch) < 128 THEN 6
    WHEN unicode(ch) < 192 OR unicode(ch) BETWEEN 8192 AND 12287 OR unicode(ch) > 65535 THEN 8 ELSE 7 END AS bin
  FROM (SELECT rid, ch, count(*) AS n FROM (SELECT rid, unnest(string_split(text, '')) AS ch FROM doc WHERE n_chars > 0) GROUP BY rid, ch)) GROUP BY rid, bin),
com AS MATERIALIZED (SELECT rid, bin, CAST(count(*) AS DOUBLE) AS n FROM (SELECT rid, CASE WHEN f IN ({_LIST}) THEN f ELSE '' END AS bin
  FROM (SELECT rid, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS f FROM doc)) GROUP BY rid, bin),
rcls AS MATERIALIZED ({_ref("cls", "n_chars")}), rcom AS MATERIALIZED ({_ref("com", "n_words")}),
jcls AS MATERIALIZED ({_js("cls", "rcls", "n_chars")}), jcom AS MATERIALIZED ({_js("com", "rcom", "n_words")}),
near AS (SELECT held.rid, bool_or((n_chars < {MIN_CHARS} OR jcls.dist <= {CLASS_LIMIT} + {CLASS_SPREAD} / sqrt(greatest(n_chars, 1)))
  AND (n_words < {MIN_COMMON} OR jcom.dist <= {COMMON_LIMIT} + {COMMON_SPREAD} / sqrt(greatest(n_words, 1)))) AS near
  FROM held JOIN jcls ON held.rid = jcls.rid AND held.ref = jcls.ref JOIN jcom ON held.rid = jcom.rid AND held.ref = jcom.ref GROUP BY held.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(near, true) AS kept FROM doc LEFT JOIN near ON doc.rid = near.rid"""
}
