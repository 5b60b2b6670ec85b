"""Touches by brute force, concurrent writers, exports read back, translation, null groups of windows."""

import datetime
import random
import threading
import tracemalloc
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from stallmetrics import schemas
from stallmetrics.functions import translate
from stallmetrics.operators import categories, checkpoints, touches
from stallmetrics.operators.versions import Versions
from stallmetrics.sources import export
from stallmetrics.streaming import measurements

T0 = datetime.datetime(2024, 3, 1, 12)


@pytest.mark.parametrize("seed", [1, 2])
def test_touches_equal_the_fold(spark, seed):
    """One user holds a third of all rows and is hardly ever silent for a minute."""
    rng, rows = random.Random(seed), []
    at = 0.0
    for _ in range(400):
        at += rng.choice([1, 7, 20, 35, 59.999999, 60, 61])
        rows.append((1, at))
    for user in range(2, 42):
        at = rng.random() * 1000
        for _ in range(20):
            at += rng.choice([0, 0.5, 30, 59, 60, 119, 121, 500])
            rows.append((user, at))
    want, last = set(), {}
    for user, at in sorted(rows):
        if user not in last or round(at * 1e6) - round(last[user] * 1e6) >= 60_000_000:
            last[user] = at
            want.add((user, round(at * 1e6)))
    frame = spark.createDataFrame([(u, round(a * 1e6)) for u, a in rows] + [(None, 5), (3, None)], "user_id long, us long").withColumn("at", F.timestamp_micros("us")).drop("us")
    found = {tuple(r) for r in touches.accepted_touches(frame).select("user_id", F.unix_micros("at")).collect()}
    assert found == want
    assert touches.accepted_touches(frame.filter("false")).count() == 0


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    """Each of six writers adds one attempt to what it has read; those that come too late read again."""
    schema = "page_key long, status string, attempts int, error_text string, checked_at timestamp"
    store = Versions(spark, str(tmp_path), schema)
    none = spark.createDataFrame([], schema)

    def fail(who: int) -> None:
        failure = spark.createDataFrame([(1, f"e{who}", T0), (10 + who, "x" * 600, T0)], "page_key long, error_text string, at timestamp")
        store.change(lambda rows: checkpoints.with_failures(none if rows is None else rows, failure, ["page_key"]).coalesce(1))

    writers = [threading.Thread(target=fail, args=(i,)) for i in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    n, rows = store.last()
    found = {r.page_key: r for r in rows.collect()}
    assert n == 6 and found[1].attempts == 6 and found[1].status == "failed" and len(found) == 7 and len(found[10].error_text) == 500


def _listings(spark):
    rows = [(s, f"{s}-{i}", 'A "title", with\na line <&>' if i == 1 else f"t{i}", None if i == 2 else 10 * i, i, f"u{i}", "Heute") for s in (1, 2, 3) for i in range(5)]
    return spark.createDataFrame(rows, "scan_id long, external_id string, title string, price_eur int, view_count int, url string, posted_text string"), spark.createDataFrame([(1, True), (2, False), (3, True)], "scan_id long, is_complete boolean")


def test_exports_read_back(spark, tmp_path):
    listings, scans = _listings(spark)
    told = export.export(listings, scans, f"{tmp_path}/csv", rows=2)
    want = sorted(map(str, listings.filter("scan_id <> 2").collect()))
    assert told["rows"] == 10 and len(told["files"]) >= 5 and told["columns"][3:5] == ["price_eur", "view_count"]
    assert sorted(map(str, export.exported(spark, f"{tmp_path}/csv").collect())) == want
    told = export.export(listings, scans, f"{tmp_path}/xlsx", kind="xlsx")
    cells = []
    for f in told["files"]:
        with zipfile.ZipFile(f"{tmp_path}/xlsx/{f['name']}") as z:
            sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        for row in list(sheet.iter(f"{ns}row"))[1:]:
            cells.append(tuple(c.findtext(f"{ns}v") or c.findtext(f"{ns}is/{ns}t") for c in row))
    # Numbers are numbers, not texts.
    assert sorted(map(str, cells)) == sorted(str(tuple(None if v is None else str(v) for v in r)) for r in listings.filter("scan_id <> 2").collect())
    assert export.export(listings.filter("false"), scans, f"{tmp_path}/none")["rows"] == 0 and export.exported(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("kind", ["csv", "xlsx"])
def test_an_export_holds_few_rows(tmp_path, kind):
    from pyspark.sql.types import StructType

    schema = StructType().add("a", "string")
    writer = export.ExportWriter(schema, {"path": str(tmp_path), "kind": kind, "rows": "50000"})
    tracemalloc.start()
    told = writer.write((f"{i:0200d}",) for i in range(60_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [n for _, n in told.files] == [50_000, 10_000] and peak < 4_000_000


def test_payloads_are_parsed_once(spark):
    for of in (checkpoints.decoded_page, checkpoints.decoded_probe, checkpoints.decoded_predictor):
        plan = spark.createDataFrame([("{}",)], "r string").select(of(F.col("r")).alias("p"))._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("parse_json") + plan.count("parsejson") == 1


def test_a_failed_export_has_no_manifest(spark, tmp_path):
    listings, scans = _listings(spark)
    bad = listings.withColumn("price_eur", F.when(F.col("external_id") == "3-4", F.raise_error(F.lit("no"))).otherwise(F.col("price_eur")).cast("int"))
    with pytest.raises(Exception, match="no"):
        export.export(bad, scans, f"{tmp_path}/x")
    assert not (tmp_path / "x" / export.MANIFEST).exists()


def test_translation(spark):
    phrases, words = {"Готово к запуску": "Ready to start", "Готово": "Done", "🔥 топ": "🔥 $1 top", "цена": "price"}, {"категория": "category", "цены": "prices", "и": "and"}
    cases = {
        "Готово к запуску": "Ready to start", "Готово!": "Done!", "НеГотово": "НеГотово", "🔥 топx": "🔥 $1 topx", "Категория и цены": "Category and prices", "оценка, цена": "оценка, price", "КАТЕГОРИЯ": "Category", "5 стр. за 10сек и 3 ч": "5 pages. за 10 sec and 3h", "": "", None: None,
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r[0]: r[1] for r in frame.select("t", translate.translated(F.col("t"), F.lit(" EN "), phrases, words)).collect()} == cases
    assert [r[0] for r in frame.select(translate.translated(F.col("t"), F.lit("ru"), phrases, words)).collect()] == list(cases)
    assert [r[0] for r in frame.select(translate.translated(F.col("t"), F.lit("en"), {}, {})).limit(2).collect()] == list(cases)[:2]


def test_windows_of_a_null_group(spark, tmp_path):
    """A second batch replaces a null group's window as it does any other."""
    schema = "ts timestamp, kind string, v long"
    for n, minute in ((1, 1), (2, 2)):
        spark.createDataFrame([(T0 + datetime.timedelta(minutes=minute), k, 1) for k in (None, "a")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        found = measurements.run_windows(measurements.windowed(stream, "ts", ["kind"], "v", "1 hour"), ["start", "end", "kind"], f"{tmp_path}/base").collect()
        assert sorted((r.kind or "", r.n) for r in found) == [("", n), ("a", n)]


def test_upgrade(spark):
    old = spark.createDataFrame([("a", 5, None)], "external_id string, price_eur short, is_active boolean")
    new = schemas.upgrade(old, schemas.LISTINGS).first()
    assert (new.external_id, new.price_eur, new.is_active, new.identity_confidence, new.title) == ("a", 5, True, 0, None)


def test_a_cycle_of_categories_is_an_error(spark):
    with pytest.raises(Exception, match="RECURSION"):
        categories.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "key string, parent string")).collect()
    closed = categories.closure(spark.createDataFrame([("r", None), ("a", "r"), ("b", "a")], "key string, parent string"))
    assert sorted(r.key for r in categories.in_group(closed, "a").collect()) == ["a", "b"]
    assert {r.key: r.root for r in categories.roots(closed).collect()} == {"r": "r", "a": "r", "b": "r"}
