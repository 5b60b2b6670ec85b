"""op10_html_text: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_text import extract


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op10_html_text": op10_html_text}
SQL: dict[str, str] = {}
