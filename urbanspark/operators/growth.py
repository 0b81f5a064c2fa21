"""Growth of zoned land, minute by minute: free lots are built on by a weighted hash order, up to each zone's quota."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from urbanspark.operators.sequences import ranked
from urbanspark.sources.tables import stored

#: share of a zone's free lots that is built on a minute, and the minutes made up for at once; fixed values
START_RATE, MOST_MINUTES = 0.02, 60
STARTED = "minute long, zone int, id long"


def chance(key: Column, minute: Column) -> Column:
    """A number from 0 to 1 that a key has in a minute."""
    return F.pmod(key.cast("long") * 7919 + minute * 104_729, F.lit(10_007)) / 10_007.0


def started(lots: DataFrame, built: DataFrame, minute: int) -> DataFrame:
    """minute, zone, id: the lots on which building starts in a minute.

    lots: id, zone (NULL: not zoned), context (storeys around), dear (weight of the land's value), rate (of the zone's demand;
    the same for all its lots); built: id. A zone gets START_RATE of its free lots times its rate, a fraction by chance, and
    one at least where the rate is not under 1. The highest of chance * (1 + context / 3) * dear go first, the smaller id of
    equals. Lots are counted by levels of that weight, so that a zone's lots never lie in one task.
    """
    now = F.lit(minute).cast("long")
    free = lots.where("zone is not null").join(built.select("id"), "id", "left_anti")
    order = chance(F.col("id"), now) * (1 + F.col("context") / 3) * F.col("dear")
    placed = ranked(free.withColumn("less", -order), ["zone"], ["less", "id"], F.floor(F.col("less") * 64))
    expected = F.col("_n") * START_RATE * F.col("rate")
    whole = F.floor(expected) + F.when(chance(F.col("zone"), now) < expected - F.floor(expected), 1).otherwise(0)
    want = F.when(F.col("rate") >= 1, F.greatest(F.lit(1), whole)).otherwise(whole)
    return placed.where(F.col("_k") < want).select(now.alias("minute"), F.col("zone").cast("int").alias("zone"), F.col("id").cast("long").alias("id"))


def grown(lots: DataFrame, minutes: list[int]) -> DataFrame:
    """What starts in the given minutes, one after the other; a minute that comes twice counts once."""
    done: list[DataFrame] = []
    for minute in sorted(set(minutes)):
        built = reduce(DataFrame.unionAll, done) if done else lots.select("id").limit(0)
        done.append(stored(started(lots, built, minute), "started"))
    return reduce(DataFrame.unionAll, done)


def built_so_far(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """What grow_on() has started, in the batches before one."""
    rows = spark.read.schema(f"{STARTED}, batch long").option("basePath", folder).parquet(folder)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def grow_on(ticks: DataFrame, lots: DataFrame, folder: str) -> DataStreamWriter:
    """Growth over a stream of ticks (minute): each batch grows the minutes it brings that are later than all before it, at
    most the first MOST_MINUTES of them. The state is the table of lots built on, a folder a batch; a batch that runs again
    reads what was there before it and writes the same folder again."""

    def grow(df: DataFrame, i: int) -> None:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fresh = not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        built = spark.createDataFrame([], STARTED) if fresh else built_so_far(spark, folder, i)
        last = built.agg(F.max("minute")).first()[0]
        due = df.select("minute").distinct().where(F.lit(True) if last is None else F.col("minute") > last)
        out = spark.createDataFrame([], STARTED)
        for row in due.orderBy("minute").limit(MOST_MINUTES).collect():
            out = stored(out.unionAll(started(lots, built.select("id").unionAll(out.select("id")), row.minute)), "growing")
        out.write.mode("overwrite").parquet(f"{folder}/batch={i:012d}")

    return ticks.writeStream.foreachBatch(grow)
