from __future__ import annotations

from weftnet.streaming.accumulate import current, latest, start, start_updates


def test_running_sum(spark, tmp_path):
    rows = [(0, 1, 1.0, 0.5), (0, 1, 2.0, 0.0), (1, 0, -1.0, 0.0)]
    for k in range(2):
        spark.createDataFrame(rows, "a long, b long, re double, im double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a long, b long, re double, im double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start(stream, ["a", "b"], "running")
    query.processAllAvailable()
    query.stop()
    t = current(spark.table("running"), ["a", "b"], [2, 2])
    assert t.data() == [0, 6 + 1j, -2, 0]


def test_updates_go_to_a_table(spark, tmp_path):
    """Only changed coordinates are written, and a repeated trigger replaces its own rows."""
    for k in range(3):
        rows = [(0, k % 2, 1.0, 0.0), (1, 0, 10.0, float(k))] if k < 2 else [(0, 0, 5.0, 0.0)]
        spark.createDataFrame(rows, "a long, b long, re double, im double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("a long, b long, re double, im double").parquet(str(tmp_path / "in"))
        query = start_updates(stream, ["a", "b"], str(tmp_path / "out"), str(tmp_path / "marks"))
        query.processAllAvailable()
        query.stop()
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.filter("trigger = 2").count() == 1
    table.filter("trigger = 2").drop("trigger").collect()
    assert current(latest(spark, str(tmp_path / "out"), ["a", "b"]), ["a", "b"], [2, 2]).data() == [6, 1, 20 + 1j, 0]
