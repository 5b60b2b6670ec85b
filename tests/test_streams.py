"""Streams that stop and start again."""

from stallmetrics.streaming import measurements as M


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    schema = "id long, at timestamp, n long"

    def rows(values):
        spark.createDataFrame(values, "id long, at string, n long").selectExpr("id", "CAST(at AS timestamp) AS at", "n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        found = M.run_upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["id"], "at", "n", str(tmp_path / "table"))
        return sorted((r.id, r.n) for r in found.collect())

    rows([(1, "2026-01-01", 1), (2, "2026-01-02", 2)])
    assert run() == [(1, 1), (2, 2)]
    rows([(1, "2026-01-03", 3), (2, "2026-01-01", 9), (3, "2026-01-01", 4)])
    assert run() == [(1, 3), (2, 2), (3, 4)]
    assert run() == [(1, 3), (2, 2), (3, 4)]
