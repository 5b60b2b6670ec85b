"""Declared schemas of the marketplace relations, and their additive upgrade (survey 1.3, 2.12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTINGS = (
    "external_id string, category_key string, category string, title string, price_text string, price_eur int, posted_text string, "
    "posted_date_msk string, url string, first_seen_at timestamp, last_seen_at timestamp, is_active boolean, is_promoted boolean, "
    "disappeared_at timestamp, view_count int, views_checked_at timestamp, identity_key string, identity_label string, "
    "identity_confidence int, ordinal long"
)
PRICE_HISTORY = "id long, external_id string, price_text string, price_eur int, recorded_at timestamp"
VIEW_HISTORY = "id long, external_id string, view_count int, recorded_at timestamp"
SCAN_LISTINGS = "scan_id long, external_id string, initial_view_count int, captured_at timestamp"
FEATURES = (
    "external_id string, category_key string, identity_key string, identity_label string, identity_confidence int, price_eur int, views int, age_minutes double, title string, family_key string"
)
ITEMS = "array<struct<external_id: string, title: string, price_text: string, price_eur: int, url: string, posted_text: string>>"

#: What a column that older data lacks gets instead of null.
NEUTRAL = {"is_active": True, "is_promoted": False, "identity_confidence": 0, "ordinal": 0}


def upgrade(df: DataFrame, schema: str, neutral: dict | None = None) -> DataFrame:
    """df in the columns of schema: missing ones are added with neutral values, types are widened by casts, others are left out."""
    neutral = NEUTRAL if neutral is None else neutral
    there = set(df.columns)
    return df.select(*[(F.coalesce(F.col(f.name), F.lit(neutral.get(f.name))) if f.name in there and f.name in neutral else F.col(f.name) if f.name in there else F.lit(neutral.get(f.name))).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])
