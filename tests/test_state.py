"""Streams that remember, over files that come one by one, stopped and started again between them."""

import datetime
import os
import time

import pytest

from stallmetrics.streaming import state

T0 = datetime.datetime(2024, 3, 1, 12)


def at(minutes, seconds=0):
    return T0 + datetime.timedelta(minutes=minutes, seconds=seconds)


class Feed:
    """A folder of files and a query over it, each run of which is a new start from the checkpoint."""

    def __init__(self, spark, folder, schema, of):
        self.spark, self.folder, self.schema, self.of, self.n = spark, folder, schema, of, 0
        state.prepare(spark)

    def put(self, *rows):
        self.n += 1
        frame = self.spark.createDataFrame(list(rows), self.schema)
        frame.coalesce(1).write.parquet(f"{self.folder}/in/{self.n}")
        for f in os.listdir(f"{self.folder}/in/{self.n}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{self.folder}/files", exist_ok=True)
                os.rename(f"{self.folder}/in/{self.n}/{f}", f"{self.folder}/files/{self.n:04}-{f}")
        time.sleep(0.01)
        stream = self.of(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/files"))
        stream.writeStream.outputMode("append").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{self.folder}/out").start().awaitTermination()
        return [tuple(r) for r in self.spark.read.parquet(f"{self.folder}/out").collect()]


@pytest.fixture
def local_zone(monkeypatch):
    monkeypatch.setenv("TZ", "UTC")
    time.tzset()


def test_measurements_are_scored_with_what_came_before(spark, tmp_path, local_zone):
    schema = "candidate_id long, at timestamp, target_hours int, views long, baseline_at timestamp, baseline_views long, initial_score int, initial_vph double, peer_median double, peer_p85 double"
    row = lambda minutes, hours, views, who=1: (who, at(minutes), hours, views, T0, 10, 90, 10.0, 5.0, 15.0)
    feed = Feed(spark, tmp_path, schema, lambda s: state.rescored(s, late="0 seconds"))
    feed.put(row(60, 1, 40), row(61, 1, None, 2))
    feed.put(row(180, 3, 200), row(180, 3, None, 2))
    feed.put(row(200, 3, None, 2), row(215, 3, None, 2))
    found = feed.put((3, at(6000), 1, None, T0, 0, 0, 0.0, 0.0, 0.0))
    by = {}
    for r in sorted(found, key=lambda r: (r[0], r[1], r[3])):
        by.setdefault(r[0], []).append(r[1:])
    first, second = by[1]
    # 30 more in an hour: (30 - 5) / 10 is full strength, three times the rate at first; 90 * 0.45 + 37 + 18.
    assert first == (at(60), 1, "done", 0, 96, "early_winner", "pending", 5, "winner", None)
    # 160 more in two hours: confirmed, its evidence added up over the restart.
    assert second == (at(180), 3, "done", 0, 96, "early_winner", "confirmed", 15, "confirmed", None)
    states = [(r[-1], *r[1:4]) for r in by[2]]
    assert (at(76), 1, "retry", 1) in states and (at(76), 1, "due", 1) in states
    assert [(s, n) for _, h, s, n in states if h == 3 and s != "due"] == [("retry", 1), ("retry", 2), ("error", 3)]


def test_entries_expire(spark, tmp_path, local_zone):
    feed = Feed(spark, tmp_path, "key string, at timestamp, payload string", lambda s: state.expiring(s, 180, late="0 seconds"))
    feed.put(("a", at(0), "old"), ("a", at(1), "new"), ("b", at(0), "x"), (None, at(0), "no"))
    feed.put(("b", at(2), "y"), ("c", at(4, 30), "z"))
    found = feed.put(("d", at(60), "end"))
    found = feed.put(("d", at(61), "end"))
    seen = {(k, p, gone) for k, _, p, gone in found}
    assert {("a", "new", False), ("a", "new", True), ("b", "x", False), ("b", "y", False), ("b", "y", True), ("c", "z", True)} <= seen
    assert ("b", "x", True) not in seen and ("a", "old", True) not in seen and not any(gone for k, _, _, gone in found if k == "d")


def test_stalled_jobs_are_resumed_twice(spark, tmp_path, local_zone):
    feed = Feed(spark, tmp_path, "job_id string, at timestamp, total int, url string, views long", state.resumed)
    feed.put(("j", at(0), 3, None, None), ("j", at(0, 30), 3, "u1", 5), ("k", at(0), 2, "u1", 1), ("k", at(0, 10), 2, "u2", 2))
    feed.put(("x", at(5), 9, None, None))
    feed.put(("j", at(6), 3, "u2", 5), ("x", at(6), 9, "u1", 1))
    feed.put(("x", at(30), 9, "u2", 1))
    for minutes in (60, 90, 120):
        found = feed.put(("x", at(minutes), 9, f"u{minutes}", 1))
    told = [(r[2], r[3], r[4], r[5]) for r in sorted(found, key=lambda r: r[1]) if r[0] == "j"]
    assert told == [("requeued", 1, 1, 2), ("requeued", 2, 2, 1), ("fallback", 2, 2, 1)]
    assert [r[2:] for r in found if r[0] == "k"] == [("done", 0, 2, 0)]
