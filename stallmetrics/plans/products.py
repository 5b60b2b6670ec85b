"""Queries of recognized products (survey T7, T12-T17): each part is advertised as a device that its size and key choose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import products as P
from ..functions import text
from . import relations as R

# What an ad says by the remainder of its key, with {gb} and {n} of the row; and what is to be recognized in it.
_ADS = (
    ("Verkaufe iPhone {n} Pro Max {gb}GB schwarz", "'apple|phone|iphone-' || n || '|pro-max|storage-' || gb || 'gb'", "'Apple · iPhone ' || n || ' · Pro Max · ' || gb || ' GB'", "94"),
    ("MacBook Air M2 16GB RAM {gb} GB SSD", "'apple|laptop|macbook-air|ram-16gb|' || CASE gb WHEN '64' THEN '' ELSE 'storage-' || gb || 'gb|' END || 'm2'", "'Apple · MacBook Air · M2 · 16 GB RAM' || CASE gb WHEN '64' THEN '' ELSE ' · ' || gb || ' GB' END", "96"),
    ("Play Station 5 Slim Digital Edition, 1,5 TB SSD, {n} Spiele", "'sony|console|ps5|slim-digital|storage-1500gb'", "'Sony · PlayStation 5 · Slim Digital · 1.5 TB'", "98"),
    ("Samsung Galaxy S{n} Ultra RAM 12GB, {gb} GB Speicher", "'samsung|phone|galaxy-s' || n || '|ultra|storage-' || gb || 'gb'", "'Samsung · Galaxy S' || n || ' · Ultra · ' || gb || ' GB'", "92"),
    ("Grafikkarte RTX 4{n}0 Ti Super OVP", "'nvidia|gpu|rtx-4' || n || '0|ti-super'", "'NVIDIA · RTX 4' || n || '0 · Ti Super'", "98"),
    ("Nintendo Switch OLED weiß mit {gb} GB Karte", "'nintendo|console|nintendo-switch|oled|storage-' || gb || 'gb'", "'Nintendo Switch · OLED · ' || gb || ' GB'", "96"),
    ("iPad Pro 12,9 Zoll {n}. Generation {gb}GB", "'apple|tablet|ipad-pro|storage-' || gb || 'gb|12-9|gen-' || n", "'Apple · iPad Pro · 12.9\" · Gen ' || n || ' · ' || gb || ' GB'", "92"),
    ("Canon EOS {n}D Kamera gebraucht", "'canon|camera|eos' || n || 'd'", "'Canon · EOS' || n || 'D'", "58"),
    ("Controller für die PS5, Nr. {n}", "'sony|controller|dualsense'", "'Sony · DualSense'", "92"),
    ("Gartentisch {n} Stühle", "''", "''", "0"),
)


def _titles():
    """What the ad of a part says."""
    n, gb = (F.col("p_size") % 9 + 10).cast("string"), F.expr("CAST(shiftleft(1, p_size % 4 + 6) AS STRING)")
    which = F.get(F.array(*[F.lit(ad) for ad, *_ in _ADS]), (F.col("p_partkey") % len(_ADS)).cast("int"))
    return F.replace(F.replace(which, F.lit("{n}"), n), F.lit("{gb}"), gb).alias("title")


def recognized_products(spark, sf):
    rows = R.table(spark, sf, "part").select("p_partkey", _titles()).withColumn("fold", text.folded("title"))
    known = rows.select("p_partkey", "title", P.recognized(F.col("fold")).alias("known"))
    return known.select("p_partkey", "title", F.col("known.key").alias("key"), F.col("known.label").alias("label"), F.col("known.confidence").alias("confidence"), P.summary(F.col("known")).alias("summary"))


def product_families(spark, sf):
    """Ads by the family that their title has: of the recognized product, else of its words. A family is found once for each title."""
    titles = R.table(spark, sf, "part").select(_titles(), "p_retailprice").groupBy("title").agg(F.count(F.lit(1)).alias("ads"), F.min("p_retailprice").alias("low"))
    family = titles.withColumn("fold", text.folded("title")).select("ads", "low", P.product_family(F.col("fold")).alias("family"))
    return family.groupBy(F.col("family.key").alias("family_key")).agg(F.sum("ads").alias("ads"), F.round(F.min("low"), 2).alias("low"), F.max("family.confidence").alias("confidence"))


QUERIES = {f.__name__: f for f in (recognized_products, product_families)}

_DEVICES = "x AS (SELECT p_partkey, p_retailprice, CAST(p_size % 9 + 10 AS VARCHAR) AS n, CAST(1 << (p_size % 4 + 6) AS VARCHAR) AS gb, p_partkey % 10 AS k FROM part)"


def _cases(of) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {of(ad)}" for i, ad in enumerate(_ADS)) + " END"


def _said(ad: tuple) -> str:
    return "'" + ad[0].replace("{n}", "' || n || '").replace("{gb}", "' || gb || '") + "'"


SQL = {
    "recognized_products": f"""WITH {_DEVICES} SELECT p_partkey, {_cases(_said)} AS title, {_cases(lambda a: a[1])} AS key, {_cases(lambda a: a[2])} AS label, CAST({_cases(lambda a: a[3])} AS INTEGER) AS confidence,
      CASE WHEN k = 9 THEN '{P.UNKNOWN}' ELSE {_cases(lambda a: a[2])} END AS summary FROM x""",
    "product_families": f"""WITH {_DEVICES}, f AS (SELECT p_retailprice, CASE k WHEN 7 THEN n || 'd canon eos kamera' WHEN 9 THEN array_to_string(list_sort([n, 'gartentisch', 'stuhle']), ' ') ELSE {_cases(lambda a: a[1])} END AS family_key,
      CASE k WHEN 7 THEN 65 WHEN 9 THEN 55 ELSE CAST({_cases(lambda a: a[3])} AS INTEGER) END AS confidence FROM x) SELECT family_key, count(*) AS ads, round(min(p_retailprice), 2) AS low, max(confidence) AS confidence FROM f GROUP BY 1""",
}
