"""What the training-data operators share: scratch tables, words, partition counts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the ASCII controls 09-0D.
SPACE = "[\\x20\\x09-\\x0D]+"
#: bytes of an Arrow batch: texts are long, and a Python worker holds a batch several times over
BATCH_BYTES = 4 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="urbanspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES for the session's Python workers, where the user has left Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864", "67108864b", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when a query inside has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared scratch folder and read back: cuts lineage, survives lost executors.

    Its shuffle files go at once, as nothing will ask for them again.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by stored() that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        base = scratch_dir(spark).split(":", 1)[-1].lstrip("/")
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if base in path:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def words_of(text: Column) -> Column:
    """The words of a text in order; none if the text is null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def bit_filter(values: DataFrame, bits: int = 1 << 20):
    """A test for the 64-bit hashes in values' one column: never false for one of them, rarely true for others.

    The table has a fixed number of bits, whatever the number of values; when full it lets everything through, so what
    it passes must still be joined.
    """
    name = values.columns[0]
    places = lambda h: [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits))]
    used = values.select(F.explode(F.array(*places(F.col(name)))).alias("bit")).distinct()
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    table = [0] * (bits // 64)
    for r in used.groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(one).alias("v")).collect():
        table[r["w"]] = r["v"]
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")

    def holds(h: Column) -> Column:
        def test(b: Column) -> Column:
            return F.getbit(F.get(literal, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

        first, second = places(h)
        return test(first) & test(second)

    return holds
