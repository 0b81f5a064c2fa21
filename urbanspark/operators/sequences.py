"""Window operators: deltas, islands, thinning, filling, interpolation, cyclic order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(df: DataFrame, key: list[str], order: list[str], bucket: Column, values: list[str], ahead: bool = False) -> DataFrame:
    """df with the values of the row before (or after) it in its key's order, as other_*: rows meet within buckets of the
    order, and only the border rows of buckets along a key, so that a key with many rows is spread over tasks."""
    named = df.withColumn("_b", bucket)
    w = Window.partitionBy(*key, "_b").orderBy(*order)
    step = F.lead if ahead else F.lag
    other = F.struct(*[F.col(v).alias(f"other_{v}") for v in values])
    inner = named.withColumn("_o", step(other).over(w))
    pick = F.min_by if ahead else F.max_by
    border = named.groupBy(*key, "_b").agg(pick(other, F.struct(*order)).alias("_e"))
    border = border.select(*key, "_b", step("_e").over(Window.partitionBy(*key).orderBy("_b")).alias("_e"))
    matched = inner.alias("i").join(border.alias("e"), reduce(lambda a, b: a & b, [F.col(f"i.{k}").eqNullSafe(F.col(f"e.{k}")) for k in [*key, "_b"]]))
    return matched.select("i.*", "e._e").withColumn("_o", F.coalesce("_o", "_e")).select(*df.columns, "_o.*")


def ranked(df: DataFrame, key: list[str], order: list[str], bucket: Column) -> DataFrame:
    """df with _k, a row's place in its key from 0, and _n, the rows of its key: counted within buckets of the order, plus the
    rows of the buckets before."""
    named = df.withColumn("_b", bucket)
    sizes = named.groupBy(*key, "_b").agg(F.count("*").alias("_s"))
    w = Window.partitionBy(*key)
    before = F.coalesce(F.sum("_s").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*key, "_b", before.alias("_before"), F.sum("_s").over(w).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*key, "_b").orderBy(*order)) - 1
    return named.withColumn("_k", place).join(sizes, [*key, "_b"]).withColumn("_k", F.col("_k") + F.col("_before")).drop("_b", "_before")


def trailing(df: DataFrame, key: list[str], at: Column, span: int) -> DataFrame:
    """df with _slot and _own, for a window of the last span units of at: each row stands in its slot of span units and, as
    context only (_own false), in the next one; windows run by key and _slot, then rows with _own stay."""
    slot = F.floor(at / span).cast("long")
    return df.withColumn("_slot", F.explode(F.array(slot, slot + 1))).withColumn("_own", F.col("_slot") == slot)


def counter_deltas(df: DataFrame, key: list[str], order: list[str], counter: str, bucket: Column | None = None) -> DataFrame:
    """Increase of a cumulative counter; after a reset the counter itself. bucket: of the order, to spread a key over tasks."""
    out = beside(df, key, order, F.lit(0) if bucket is None else bucket, [counter])
    before = F.col(f"other_{counter}")
    return out.withColumn("delta", F.when(before.isNull() | (F.col(counter) < before), F.col(counter)).otherwise(F.col(counter) - before)).drop(f"other_{counter}")


def islands(df: DataFrame, key: list[str], day: Column) -> DataFrame:
    """Runs of consecutive days of the distinct (key, day) rows: first, last, days."""
    days = df.select(*key, day.alias("_d")).distinct()
    group = F.col("_d") - F.row_number().over(Window.partitionBy(*key).orderBy("_d"))
    return days.withColumn("_g", group).groupBy(*key, "_g").agg(F.min("_d").alias("first"), F.max("_d").alias("last"), F.count(F.lit(1)).alias("days")).drop("_g")


def thin(df: DataFrame, key: list[str], order: list[str], keep: Column, bucket: Column | None = None) -> DataFrame:
    """keep (of _n, the rows of a key) of n rows, evenly: row k stays if floor((k + 1) m / n) > floor(k m / n)."""
    placed = ranked(df, key, order, F.lit(0) if bucket is None else bucket).withColumn("_m", keep)
    return placed.where(F.floor((F.col("_k") + 1) * F.col("_m") / F.col("_n")) > F.floor(F.col("_k") * F.col("_m") / F.col("_n"))).drop("_k", "_n", "_m")


def fill_gaps(df: DataFrame, key: list[str], time: str, copies: int, longest: int, ties: list[str], bucket: Column | None = None) -> DataFrame:
    """copies more rows in each gap of at most longest seconds, evenly spaced; added: 0 for the rows themselves."""
    spread = beside(df, key, [time, *ties], F.lit(0) if bucket is None else bucket, [time], ahead=True).withColumn("_gap", F.col(f"other_{time}") - F.col(time))
    n = F.when(F.col("_gap").between(1, longest), copies).otherwise(0)
    spread = spread.withColumn("added", F.explode(F.sequence(F.lit(0), n)))
    at = F.col(time) + F.when(F.col("added") > 0, F.floor(F.col("_gap") * F.col("added") / (copies + 1))).otherwise(0)
    return spread.withColumn(time, at.cast("long")).drop("_gap", f"other_{time}")


def collapse(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_b", before).where(~F.col(value).eqNullSafe(F.col("_b"))).drop("_b")


def sessions(df: DataFrame, key: list[str], seconds: Column, gap: int) -> DataFrame:
    """Runs of rows with gaps of at most gap seconds: start, end, n."""
    timed = df.select(*key, seconds.alias("_t"))
    w = Window.partitionBy(*key).orderBy("_t")
    new = F.when(F.col("_t") - F.lag("_t").over(w) <= gap, 0).otherwise(1)
    numbered = timed.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "session").agg(F.min("_t").alias("start"), F.max("_t").alias("end"), F.count(F.lit(1)).alias("n"))
