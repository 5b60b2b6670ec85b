"""op5_substring_dedup: each document without the words of repeated windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .substring_dedup import WINDOW, remove_repeats


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}

SQL = {
    "op5_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, list_slice(w, i, i + {WINDOW - 1}) AS s FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS n FROM win) WHERE n >= 2),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM rep),
kept AS (SELECT u.rid, string_agg(u.word, ' ' ORDER BY u.p) AS k, count(*) AS n
  FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) u ANTI JOIN gone g ON u.rid = g.rid AND u.p = g.p GROUP BY u.rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.k, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.rid = k.rid"""
}
