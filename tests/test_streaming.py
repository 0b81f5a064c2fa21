"""Streams drained once give what the batch gives."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from urbanspark.streaming import passes

SCHEMA = "pass_id long, ts timestamp, vehicle long, edge_id long, kmh double"


@pytest.fixture
def stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 7)
    rows = [(i, t + dt.timedelta(minutes=i * 7), i % 3, i % 2, 30.0 + i) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "in"))


def drain(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}")


def test_tumbling(stream, tmp_path):
    live, batch = stream
    got = {(r.edge_id, r.start, r.n) for r in drain(passes.tumbling(live), "complete", tmp_path, "tumbling").collect()}
    want = {(r.edge_id, r.start, r.n) for r in batch.groupBy("edge_id", F.date_trunc("hour", "ts").alias("start")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_sliding_counts_each_row_four_times(stream, tmp_path):
    live, batch = stream
    assert sum(r.n for r in drain(passes.sliding(live), "complete", tmp_path, "sliding").collect()) == 4 * batch.count()


def test_sessions(stream, tmp_path):
    """Append mode gives the sessions that the watermark has closed: all but those of the last minutes."""
    live, batch = stream
    got = {(r.vehicle, r.start, r.n) for r in drain(passes.stuck(live, "1800 seconds"), "append", tmp_path, "stuck").collect()}
    every = {(r.vehicle, r.start, r.n) for r in passes.stuck(batch, "1800 seconds").collect()}
    assert got <= every
    live_short = {(r.vehicle, r.start, r.n) for r in drain(passes.stuck(live, "600 seconds"), "append", tmp_path, "short").collect()}
    short = {(r.vehicle, r.start, r.n) for r in passes.stuck(batch, "600 seconds").collect()}
    assert live_short <= short and 0 < len(short) - len(live_short) <= 4


def test_days_come_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 7)
    rows = [(i, t + dt.timedelta(hours=i * 5), 1, 1, 30.0 + i) for i in range(15)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = sorted((r.start.day, r.n) for r in drain(passes.day_totals(live), "append", tmp_path, "days").collect())
    assert got == [(1, 4), (2, 5), (3, 4)]  # the fourth day is not over


def test_two_runs_in_step(stream, spark, tmp_path):
    live, batch = stream
    other = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withColumn("kmh", F.col("kmh") + 1)
    got = drain(passes.in_step(live, other), "append", tmp_path, "step").collect()
    assert len(got) == batch.count() and all(r.b_kmh == r.a_kmh + 1 for r in got)


def test_clock_that_goes_back(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 7)
    rows = [(i, t + dt.timedelta(minutes=m), 1, 1, 30.0) for i, m in enumerate([0, 5, 9, 2, 3])]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert [(r.vehicle, r.n) for r in drain(passes.since_restart(live), "update", tmp_path, "restart").collect()] == [(1, 2)]


def test_snapshots_and_partial_sums(stream, spark, tmp_path):
    live, batch = stream
    for f, name in ((passes.snapshots, "snap"), (passes.partial_sums, "sums")):
        f(live, str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination(120)
    assert passes.latest_snapshot(spark, str(tmp_path / "snap"), SCHEMA).count() == batch.count()
    assert {r.edge_id: r.n for r in passes.running_totals(spark, str(tmp_path / "sums")).collect()} == {r.edge_id: r["count"] for r in batch.groupBy("edge_id").count().collect()}


def test_first_seen(stream, tmp_path):
    live, batch = stream
    assert drain(passes.first_seen(live), "append", tmp_path, "seen").count() == batch.select("edge_id", "vehicle").distinct().count()


def test_smoothed(stream, tmp_path):
    live, batch = stream
    got = {r.edge_id: r.kmh for r in drain(passes.smoothed(live), "update", tmp_path, "smoothed").collect()}
    for edge in (0, 1):
        value = None
        for r in batch.where(F.col("edge_id") == edge).orderBy("ts").collect():
            value = r.kmh if value is None else (value + r.kmh) / 2
        assert got[edge] == pytest.approx(value)
