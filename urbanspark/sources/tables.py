"""Tables in the session's shared folders, and readers of the usual open-data formats."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the folder spark.checkpoint.dir names; local sessions get a folder of their own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="urbanspark-"))
    return df.checkpoint()


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ";", encoding: str = "cp1250") -> DataFrame:
    """Delimited text with a header in a legacy one-byte encoding; bad rows become NULLs.

    Spark reads the bytes as Latin-1; string columns are then translated, letter by letter, to what the bytes mean.
    """
    df = spark.read.schema(schema).options(header=True, sep=sep, encoding="iso-8859-1", mode="PERMISSIVE", enforceSchema=True).csv(path)
    bytes_ = [(chr(b), bytes([b]).decode(encoding, "ignore")) for b in range(128, 256)]
    known = [(x, y) for x, y in bytes_ if len(y) == 1]
    plain = lambda c: F.translate(c, "".join(x for x, _ in known), "".join(y for _, y in known))
    return df.select(*[plain(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read_gtfs(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A member of an unpacked GTFS feed, the byte order mark of its header ignored."""
    return spark.read.schema(schema).options(header=True, enforceSchema=True).csv(f"{folder}/{name}.txt")


def read_network(spark: SparkSession, path: str, element: str, schema: str) -> DataFrame:
    """Elements of a network in XML; attributes are columns with a leading underscore."""
    return spark.read.schema(schema).format("xml").option("rowTag", element).load(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents that span lines; missing keys are NULL."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_layer(df: DataFrame, path: str, order: list[str], partition: list[str] | None = None) -> None:
    """A layer as Parquet, sorted within its files."""
    w = df.sortWithinPartitions(*order).write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """Catalog upsert: the newest version of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(version))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pack_deltas(df: DataFrame, key: list[str], order: str, column: str, unit: float = 0.01, longest: int = 32_767) -> DataFrame:
    """A coordinate as steps of whole units. A step beyond longest becomes several rows (part of parts) that add up to it."""
    at = F.round(F.col(column) / unit).cast("long")
    w = Window.partitionBy(*key).orderBy(order)
    step = at - F.coalesce(F.lag(at).over(w), F.lit(0))
    parts = F.when((F.row_number().over(w) == 1) | F.col("_step").isNull(), 1).otherwise(F.greatest(F.ceil(F.abs("_step") / longest), F.lit(1))).cast("int")
    cut = df.withColumn("_step", step).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(1), "parts")))
    until = lambda k: F.floor(F.col("_step") * k / F.col("parts"))
    return cut.withColumn("step", F.when(F.col("parts") == 1, F.col("_step")).otherwise(until(F.col("part")) - until(F.col("part") - 1))).drop("_step")


def unpack_deltas(df: DataFrame, key: list[str], order: str, unit: float = 0.01) -> DataFrame:
    """The rows of pack_deltas() put together again, with value."""
    w = Window.partitionBy(*key).orderBy(order, "part").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.sum("step").over(w) * unit).where("part = parts").drop("part", "parts")


def terrain_height(r, g, b, scale: float = 0.1, offset: float = 10_000.0):
    """Height of an RGB-coded terrain pixel."""
    return (r * 65_536 + g * 256 + b) * scale - offset


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_sheets(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """path, row (from 1) and cells (column letters -> text) of a worksheet of each workbook; a workbook is one task's work."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    shared = []
                    if "xl/sharedStrings.xml" in book.namelist():
                        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
                    out = []
                    for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_SHEET}row"):
                        cells = {}
                        for c in row.iter(f"{_SHEET}c"):
                            value = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else c.findtext(f"{_SHEET}v")
                            if value is not None:
                                cells[c.get("r").rstrip("0123456789")] = shared[int(value)] if c.get("t") == "s" else value
                        out.append((name, int(row.get("r")), cells))
                yield pd.DataFrame(out, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, row int, cells map<string, string>")


def wkb_points(shape: Column) -> Column:
    """Points of a well-known-binary point, line or polygon (its outer ring); NULL for other kinds."""

    def decode(b: bytes | None):
        if b is None or len(b) < 5:
            return None
        end = "<" if b[0] == 1 else ">"
        kind = int(np.frombuffer(b, f"{end}u4", 1, 1)[0]) % 1000
        if kind not in (1, 2, 3):
            return None
        at = {1: 5, 2: 9, 3: 13}[kind]
        n = 1 if kind == 1 else int(np.frombuffer(b, f"{end}u4", 1, at - 4)[0]) if len(b) >= at else 0
        return [{"x": x, "y": y} for x, y in np.frombuffer(b, f"{end}f8", 2 * n, at).reshape(n, 2).tolist()]

    def points(shapes: pd.Series) -> pd.Series:
        return shapes.map(decode)

    return F.pandas_udf(points, "array<struct<x: double, y: double>>")(shape)


def save_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_state(spark: SparkSession, path: str, schema: str, valid: Column, order: str, most: int) -> DataFrame:
    """Saved rows that parse and are valid, the last `most` by order: what does not hold is left out, not trusted."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.coalesce(valid, F.lit(False))).orderBy(F.desc(order)).limit(most)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet under spark.checkpoint.dir and read back, to be dropped by discard() when it is used up."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="urbanspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by stored() that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
