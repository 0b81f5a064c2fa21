"""Streams of passes: windows, days, sessions, two runs in step, running states, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Passes and mean speed per edge and window; rows later than `late` are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width), "edge_id").agg(F.count(F.lit(1)).alias("n"), F.avg("kmh").alias("kmh"))
    return out.select("edge_id", F.col("window.start").alias("start"), "n", "kmh")


def sliding(stream: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width, step), "edge_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("edge_id", F.col("window.start").alias("start"), "n")


def stuck(stream: DataFrame, gap: str = "300 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a vehicle with pauses shorter than gap."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap), "vehicle").agg(F.count(F.lit(1)).alias("n"))
    return out.select("vehicle", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The first pass of each vehicle on each edge within the watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(["edge_id", "vehicle"])


def smoothed(stream: DataFrame, weight: float = 0.5) -> DataFrame:
    """Each edge's exponentially smoothed speed after every batch; the state is one number an edge."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "pass_id"])
        for kmh in rows["kmh"]:
            value = kmh if value is None else value * (1 - weight) + kmh * weight
        state.update((float(value),))
        yield pd.DataFrame({"edge_id": [key[0]], "kmh": [float(value)]})

    return stream.groupBy("edge_id").applyInPandasWithState(update, "edge_id long, kmh double", "kmh double", "update", GroupStateTimeout.NoTimeout)


def day_totals(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Passes and mean speed of each day and edge; in append mode a day comes out once, after midnight has passed."""
    return tumbling(stream, "1 day", late)


def in_step(a: DataFrame, b: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Speeds of two runs on the same edge in the same minute; neither side waits longer than late."""

    def minutes(run: DataFrame, side: str) -> DataFrame:
        minute = F.date_trunc("minute", F.col("ts").cast("timestamp"))
        return run.select(minute.alias(f"{side}_minute"), F.col("edge_id").alias(f"{side}_edge"), F.col("kmh").alias(f"{side}_kmh")).withWatermark(f"{side}_minute", late)

    joined = minutes(a, "a").join(minutes(b, "b"), F.expr("a_edge = b_edge and a_minute = b_minute"))
    return joined.select(F.col("a_edge").alias("edge_id"), F.col("a_minute").alias("minute"), "a_kmh", "b_kmh")


def since_restart(stream: DataFrame) -> DataFrame:
    """Each vehicle's passes since its clock last went back (a new visit starts from nothing), after every batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        for ts in pd.concat(list(batches)).sort_values("pass_id")["ts"]:
            now = ts.value
            n = 1 if last is None or now < last else n + 1
            last = now
        state.update((last, n))
        yield pd.DataFrame({"vehicle": [key[0]], "n": [n]})

    return stream.groupBy("vehicle").applyInPandasWithState(update, "vehicle long, n long", "last long, n long", "update", GroupStateTimeout.NoTimeout)


def snapshots(stream: DataFrame, folder: str) -> DataStreamWriter:
    """Every batch replaces the set before it: a folder a batch, the same one again if the batch is run again."""
    return stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/batch={i:012d}"))


def latest_snapshot(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest set that snapshots() has finished; columns as in schema."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", folder).parquet(folder)
    return rows.where(F.col("batch") == rows.agg(F.max("batch").alias("m")).first()["m"]).drop("batch")


def partial_sums(stream: DataFrame, folder: str) -> DataStreamWriter:
    """Work done piece by piece: each batch adds its counts by edge, which running_totals() sums up."""

    def add(df: DataFrame, i: int) -> None:
        df.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/batch={i:012d}")

    return stream.writeStream.foreachBatch(add)


def running_totals(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("edge_id long, n long, batch long").option("basePath", folder).parquet(folder).groupBy("edge_id").agg(F.sum("n").alias("n"))
