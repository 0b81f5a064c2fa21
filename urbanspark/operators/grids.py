"""Grids of square cells: measurements a cell, values between cells, sums over boxes on a dense raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanspark.operators.spatial import cell


def cell_sources(lots: DataFrame, size: float) -> DataFrame:
    """cx, cz, edge: the street to measure each cell from, that of the lot (lot, x, z, edge) nearest its centre, the smaller
    lot of equals; lots without a street don't count."""
    cx, cz = cell(F.col("x"), size), cell(F.col("z"), size)
    off = F.hypot(F.col("x") - (cx + 0.5) * size, F.col("z") - (cz + 0.5) * size)
    best = lots.where("edge is not null").groupBy(cx.alias("cx"), cz.alias("cz")).agg(F.min(F.struct(off.alias("d"), "lot", "edge")).alias("b"))
    return best.select("cx", "cz", "b.edge")


def blended(old: DataFrame, new: DataFrame, share: float = 0.5) -> DataFrame:
    """cx, cz, value: a measurement merged into the earlier one, counting share where both have a number, else whichever has."""
    a, b = F.nanvl("a", F.lit(None)), F.nanvl("b", F.lit(None))
    both = old.select("cx", "cz", F.col("value").alias("a")).join(new.select("cx", "cz", F.col("value").alias("b")), ["cx", "cz"], "full")
    return both.select("cx", "cz", F.coalesce(share * b + (1 - share) * a, b, a).alias("value"))


def between_cells(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """points with value: that of the four cells whose centres surround them, by nearness in both directions, over those of
    them that have a number; NULL where none has."""
    fx, fz = F.col("x") / size - 0.5, F.col("z") / size - 0.5
    tx, tz = fx - F.floor(fx), fz - F.floor(fz)
    corner = lambda dx, dz, w: F.struct((F.floor(fx) + dx).cast("long").alias("cx"), (F.floor(fz) + dz).cast("long").alias("cz"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - tx) * (1 - tz)), corner(1, 0, tx * (1 - tz)), corner(0, 1, (1 - tx) * tz), corner(1, 1, tx * tz))
    around = points.select("id", F.inline(corners)).where("w > 0").join(cells.where("value is not null and not isnan(value)"), ["cx", "cz"])
    mean = around.groupBy("id").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return points.join(mean, "id", "left")


def land_value(reach: Column, reference: Column, green: Column, services: Column, response: Column, loss: Column) -> Column:
    """100 at the reference's reach, by the fixed power of reach and bonuses of green land, services and quick response."""
    power, green_bonus, service_bonus = 0.75, 0.1, 0.1
    return 100 * F.pow(reach / reference, F.lit(power)) * (1 + green_bonus * green / 100) * (1 + service_bonus * services + response) * (1 - loss)


def _running(df: DataFrame, along: str, across: str, tile: int) -> DataFrame:
    """v summed up along one direction: within tiles, plus the totals of the tiles before."""
    t = F.floor(F.col(along) / tile).cast("long")
    df = df.withColumn("_t", t)
    carry = df.groupBy(across, "_t").agg(F.sum("v").alias("_s"))
    carry = carry.select(across, "_t", F.coalesce(F.sum("_s").over(Window.partitionBy(across).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c"))
    inside = F.sum("v").over(Window.partitionBy(across, "_t").orderBy(along).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("v", inside).join(carry, [across, "_t"]).select("cx", "cz", (F.col("v") + F.col("_c")).alias("v"))


def box_sums(values: DataFrame, radius: int, tile: int = 256) -> DataFrame:
    """cx, cz, v for every cell of the raster, empty ones too: v summed over the cells at most radius away in both directions.

    values: cx, cz, v of occupied cells; the raster is their bounding box. A summed-area table is built by tiles, border
    totals carried on; each of its cells then counts with its sign in the four boxes that have it as a corner.
    """
    box = values.agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cz").alias("z0"), F.max("cz").alias("z1")).where("x0 is not null")
    rows = box.select("x0", "x1", "z0", "z1", F.explode(F.sequence(F.col("z0"), F.col("z1") + radius)).alias("cz")).repartition("cz")
    cells = rows.select("x0", "x1", "z0", "z1", "cz", F.explode(F.sequence(F.col("x0"), F.col("x1") + radius)).alias("cx"))
    full = cells.join(values, ["cx", "cz"], "left").select("cx", "cz", F.coalesce("v", F.lit(0)).alias("v"))
    table = _running(_running(full, "cx", "cz", tile), "cz", "cx", tile)
    near, far = -radius, radius + 1
    terms = F.array(*(F.struct((F.col("cx") + dx).alias("cx"), (F.col("cz") + dz).alias("cz"), (sign * F.col("v")).alias("v")) for dx, dz, sign in ((near, near, 1), (far, near, -1), (near, far, -1), (far, far, 1))))
    sums = table.select(F.inline(terms)).groupBy("cx", "cz").agg(F.sum("v").alias("v"))
    wanted = cells.where("cx <= x1 and cz <= z1").select("cx", "cz")
    return wanted.join(sums, ["cx", "cz"])


def smoothed(df: DataFrame, key: str, order: list[str], bucket: Column, value: str, share: float = 0.5) -> DataFrame:
    """key, smoothed: exponential smoothing of a key's values in order, from its first value on.

    Each time bucket is folded by itself into (values, weighted sum); these add up in order, a later value halving the
    weight of all before it, so no row ever holds a key's values.
    """
    place = Window.partitionBy(key, "_b").orderBy(*[F.desc(c) for c in order])
    weight = share * F.pow(F.lit(1 - share), F.row_number().over(place) - 1)
    rows = df.withColumn("_b", bucket).withColumn("_w", weight * F.col(value))
    first = F.min_by(value, F.struct(*order))
    parts = rows.groupBy(key, "_b").agg(F.count("*").alias("n"), F.sum("_w").alias("s"), first.alias("first"))
    later = Window.partitionBy(key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    parts = parts.withColumn("after", F.coalesce(F.sum("n").over(later), F.lit(0)))
    decay = lambda n: F.pow(F.lit(1 - share), n)
    # the first value stands for all before it
    total = F.sum(F.col("s") * decay(F.col("after"))) + decay(F.sum("n")) * F.min_by("first", "_b")
    return parts.groupBy(key).agg(total.alias("smoothed"))
