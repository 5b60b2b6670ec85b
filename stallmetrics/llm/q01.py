"""op1_token_counts: tokens of each line of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .token_counts import attribute

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attribute(table(spark, sf_dir, "documents"), PATH, PATTERN, "most")
    return found.select("doc_id", "section", "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "doc_tokens")


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
