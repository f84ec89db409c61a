"""Streams of files and records."""

import datetime as dt

from pyspark.sql import functions as F

from skyloom.streaming import files as stream
from tests.test_sources import sample


def run(df, spark, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_files_that_arrive(spark, tmp_path):
    path = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.bin").write_bytes(sample())
    df = stream.read_stream(spark, path, f"{path}/f0.bin", ["Epoch", "year"], most=1)
    assert df.isStreaming and run(df, spark, "arrived").count() == 15


def test_windows_and_repeats(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    for i, rows in enumerate(([(1, 0, 5.0), (2, 30, 500.0), (1, 0, 5.0)], [(3, 90, 7.0), (1, 0, 5.0)], [(4, 60 * 24, 1.0)])):
        spark.createDataFrame([(k, at + dt.timedelta(minutes=m), v) for k, m, v in rows], "id long, t timestamp, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    rows = spark.readStream.schema("id long, t timestamp, v double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    once = stream.new_records(rows, ["id"], "t", "2 hours")
    assert sorted(r["id"] for r in run(once, spark, "once").collect()) == [1, 2, 3, 4]
    stats = stream.windowed_stats(rows, "t", "v", "1 hour", "2 hours", high=100.0).select(F.col("window.start").alias("t"), "n_values", "max_value", "n_high")
    got = {r["t"].hour: (r["n_values"], r["max_value"], r["n_high"]) for r in run(stats, spark, "stats", "complete").collect() if r["t"].day == 1}
    assert got == {0: (4, 5.0, 1), 1: (1, 7.0, 0)}
