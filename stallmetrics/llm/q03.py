"""op3_token_shards: ids of all documents, read back from wavelet-matrix shards."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleaned_up, shared_dir, table
from .token_shards import read_documents, write_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    with cleaned_up(spark):
        shards = write_shards(table(spark, sf_dir, "documents"), PATH, f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}")
    return read_documents(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op3_token_shards": op3_token_shards}
SQL: dict[str, str] = {}
