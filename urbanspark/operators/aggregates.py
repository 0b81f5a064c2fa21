"""Aggregates: weighted means, apportionment, majority, matrices, catchments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(value * weight) / sum(weight) over rows with a value; NULL without weight."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def pass_shares(passes: DataFrame, edges: DataFrame) -> DataFrame:
    """Passes with their edge and share of its limit, at most 1. Edges without a pass are not in it."""
    joined = passes.join(edges, "edge_id")
    return joined.select("road", "edge_id", "length", "ts", "vehicle", "kmh", F.hour("ts").cast("long").alias("hour"), F.least(F.col("kmh") / F.col("limit_kmh"), F.lit(1.0)).alias("share"))


def group_shares(df: DataFrame, group: list[str], value: str, name: str = "share") -> DataFrame:
    """Each row's share of its group's total; NULL where the total is 0."""
    return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*group))))


def apportion(parts: DataFrame, totals: DataFrame, zone: str, area: str, total: str) -> DataFrame:
    """A zone's total over its parts by area; 0 where the zone has no area."""
    areas = parts.groupBy(zone).agg(F.sum(area).alias("_area"))
    factor = areas.join(totals, zone, "left").select(zone, F.coalesce(F.try_divide(F.col(total), F.col("_area")), F.lit(0.0)).alias("_f"))
    return parts.join(factor, zone).withColumn("value", F.col(area) * F.col("_f")).drop("_f")


def majority(df: DataFrame, key: list[str], vote: str, weight: str) -> DataFrame:
    """The vote with the largest summed weight of each key; the smaller vote of equals."""
    sums = df.groupBy(*key, vote).agg(F.sum(weight).alias("_w"))
    return sums.groupBy(*key).agg(F.min_by(vote, F.struct(-F.round("_w", 6), F.col(vote))).alias(vote), F.max("_w").alias("weight"))
