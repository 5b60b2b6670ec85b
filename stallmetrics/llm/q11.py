"""op11_resample: documents drawn towards the distribution of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .resample import BUCKETS, LEAST, PERCENT, SEED, resample


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_resample": op11_resample}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _features(source: str) -> str:
    return f"SELECT rid, unnest(w) AS f FROM {source} UNION ALL SELECT rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {source}"


#: The table of CRC-32 by its polynomial, and the sum of a text's bytes through it.
CRC_TABLE = """SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))"""


def crc(text: str) -> str:
    """Unsigned CRC-32 of a text, in the scope of CRC_TABLE's steps."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + strlen({text})), lambda nth: CAST('0x' || substr(hex(encode({text})), 2 * nth - 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


SQL = {
    "op11_resample": rf"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT 0 AS rid, {_WORDS} AS w FROM benchmark),
df AS MATERIALIZED ({_features("d")}), bf AS MATERIALIZED ({_features("b")}),
names AS MATERIALIZED (SELECT f, {crc("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf) t, crc),
s AS (SELECT bucket, count(*) AS n FROM df JOIN names USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM bf JOIN names USING (f) GROUP BY bucket),
gain AS MATERIALIZED (SELECT i AS bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {BUCKETS})::DOUBLE) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain
  FROM range({BUCKETS}) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
sums AS (SELECT rid, count(*) AS n, sum(gain) AS total FROM df JOIN names USING (f) JOIN gain USING (bucket) GROUP BY rid),
w AS (SELECT d.rid, doc_id, text, len(w) AS n_words, CAST(coalesce(sums.n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total::DOUBLE / sums.n), 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN sums ON d.rid = sums.rid),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST} ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_words >= {LEAST}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM ordered"""
}
