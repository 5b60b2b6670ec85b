"""Titles as words, identity and family."""

from pyspark.sql import functions as F

from stallmetrics.functions import text

TITLES = [
    ("Sony Play Station 5 Slim Digital schwarz OVP", "digital ps5 slim"),
    ("Apple iPhone 13 Pro 128 GB blau neuwertig", "128gb 13 iphone pro"),
    ("Biete neu original", ""),
    ("", ""),
    (None, ""),
    ("Bosch Bohrmaschine rot 2x", "bohrmaschine bosch"),
    ("Sony Kopfhörer", "kopfhorer sony"),
]


def test_family_keys(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TITLES)], "i int, title string")
    rows = df.withColumn("fold", text.folded("title")).withColumn("fam", text.family_of(text.identity_words(F.col("fold")))).orderBy("i").collect()
    assert [r.fam.key for r in rows] == [k for _, k in TITLES]
    by_title = {r.title: r.fam.confidence for r in rows}
    assert by_title[""] == 0 and by_title[TITLES[0][0]] == 100 and by_title[TITLES[5][0]] == 35


def test_opportunity_family(spark):
    df = spark.createDataFrame([("Makita Akkuschrauber DHP484 18V", "tools"), ("Sofa", "home"), ("", None)], "title string, category string")
    found = [r[0] for r in df.select(text.opportunity_family(text.folded("title"), F.col("category"))).collect()]
    assert found == ["fam:tools:makita|dhp484", "", ""]


def test_contains_any_needs_whole_words(spark):
    df = spark.createDataFrame([("ps5 konsole",), ("konsolentisch",)], "normal string")
    assert [r[0] for r in df.select(text.contains_any(F.col("normal"), ["Konsole"])).collect()] == [True, False]
    assert not any(r[0] for r in df.select(text.contains_any(F.col("normal"), ["neu"])).collect())


def test_prices(spark):
    df = spark.createDataFrame([("1.250 € VB",), ("VB",), (None,)], "t string")
    assert [r[0] for r in df.select(text.parse_price(F.col("t"))).collect()] == [1250, None, None]
