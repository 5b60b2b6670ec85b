"""op6_language_id: languages of all documents by a model of those that aren't held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language import held_out, predict, train


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    return predict(docs, train(docs.filter(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
SQL: dict[str, str] = {}
