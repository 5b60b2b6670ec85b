"""op12_sentence_pieces: ids of whole texts and the text they decode to."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sentence_pieces import decode, encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode(encode(table(spark, sf_dir, "documents"), PATH), PATH)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_sentence_pieces": op12_sentence_pieces}
SQL: dict[str, str] = {}
