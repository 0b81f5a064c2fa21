"""Lines as tables of measured segments: linear referencing, matching of drawn lines, crossings of a boundary.

Lines are (line, points), points an array of structs x, z. Joins run over the square cells that a segment runs through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urbanspark.functions.formulas import segment_distance
from urbanspark.operators.spatial import cell, nearest

_ENDS = ("ax", "az", "bx", "bz")


def _street(name: Column, stop: tuple[str, ...]) -> Column:
    """A street's name in lower case without the words for street."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"\b({'|'.join(stop)})\b", " "), r"\s+", " "))


def segments(lines: DataFrame) -> DataFrame:
    """line, seq, ax, az, bx, bz, start (metres along the line before it), length. A line of one point has one of length 0."""
    n = F.size("points")
    pairs = F.zip_with(F.slice("points", 1, F.greatest(n - 1, F.lit(1))), F.slice("points", F.least(n, F.lit(2)), F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a["x"].alias("ax"), a["z"].alias("az"), b["x"].alias("bx"), b["z"].alias("bz")))
    rows = lines.where(n > 0).select("line", F.posexplode(pairs).alias("seq", "s")).select("line", "seq", "s.*")
    rows = rows.withColumn("length", F.hypot(F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")))
    before = Window.partitionBy("line").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0.0)))


def _columns(size: float, reach: float, names: tuple[str, ...] = _ENDS) -> Column:
    """The columns of cells in which a point at most reach from the segment can lie."""
    ax, _, bx, _ = (F.col(n) for n in names)
    return F.sequence(cell(F.least(ax, bx) - reach, size), cell(F.greatest(ax, bx) + reach, size))


def _rows(c: Column, size: float, reach: float, names: tuple[str, ...] = _ENDS) -> Column:
    """Of column c, the rows of cells in which such a point can lie."""
    ax, az, bx, bz = (F.col(n) for n in names)
    dx, dz = bx - ax, bz - az
    # shares of the segment at the column's sides; an upright one runs through a single column
    share = lambda x, upright: F.when(dx == 0, upright).otherwise(F.least(F.greatest((x - ax) / F.nullif(dx, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    z0, z1 = az + share(c * size - reach, 0.0) * dz, az + share((c + 1) * size + reach, 1.0) * dz
    return F.sequence(cell(F.least(z0, z1) - reach, size), cell(F.greatest(z0, z1) + reach, size))


def segment_cells(size: float, reach: float = 0.0, names: tuple[str, ...] = _ENDS) -> Column:
    """The cells in which a point at most reach from the segment can lie, column by column: an array of structs cx, cz."""
    column = lambda c: F.transform(_rows(c, size, reach, names), lambda k: F.struct(c.alias("cx"), k.alias("cz")))
    return F.flatten(F.transform(_columns(size, reach, names), column))


def _in_cells(segs: DataFrame, size: float, reach: float) -> DataFrame:
    return segs.withColumn("_cx", F.explode(_columns(size, reach))).withColumn("_cz", F.explode(_rows(F.col("_cx"), size, reach)))


def nearest_segments(points: DataFrame, segs: DataFrame, cutoff: float, on: tuple[str, ...] = ()) -> DataFrame:
    """id, x, z, dist and the nearest segment within cutoff, and of equal columns on, of each point (id, x, z): the smaller
    line of equals, then the earlier segment.

    Two passes over the pairs: the first keeps one number a point, the second those as near as that; neither sorts or
    writes the pairs.
    """
    from urbanspark.sources.tables import stored

    keyed = points.select("id", "x", "z", *on, cell(F.col("x"), cutoff).alias("_cx"), cell(F.col("z"), cutoff).alias("_cz"))
    dist = segment_distance(*(F.col(c) for c in ("x", "z", *_ENDS)))
    lean = keyed.join(_in_cells(segs.select(*_ENDS, *on), cutoff, cutoff), ["_cx", "_cz", *on]).select("id", dist.alias("dist"))
    least = stored(lean.where(F.col("dist") <= cutoff).groupBy("id").agg(F.min("dist").alias("least")), "nearest")
    near = keyed.join(least, "id").join(_in_cells(segs, cutoff, cutoff), ["_cx", "_cz", *on]).withColumn("dist", dist).where("dist = least")
    return near.groupBy("id").agg(F.min(F.struct("dist", "line", "seq", "x", "z", *_ENDS, "start", "length")).alias("b")).select("id", "b.*")


def project(points: DataFrame, segs: DataFrame, cutoff: float) -> DataFrame:
    """id, line, measure, offset, heading of each point (id, x, z) with a line within cutoff: the nearest one (the smaller
    line of equals, then the earlier segment), metres along it, metres to its left, and its direction atan2(dx, dz)."""
    best = nearest_segments(points, segs, cutoff)
    dx, dz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az")
    along = ((F.col("x") - F.col("ax")) * dx + (F.col("z") - F.col("az")) * dz) / F.nullif(F.col("length"), F.lit(0.0))
    left = (F.col("x") - F.col("ax")) * dz - (F.col("z") - F.col("az")) * dx
    measure = F.col("start") + F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.col("length")), F.lit(0.0))
    return best.select("id", "line", measure.alias("measure"), F.when(left < 0, -F.col("dist")).otherwise(F.col("dist")).alias("offset"), F.atan2(dx, dz).alias("heading"))


def interpolate(at: DataFrame, segs: DataFrame, bucket: float = 250.0) -> DataFrame:
    """at (id, line, measure, offset) with x, z and heading: measure metres along the line, held to its ends, offset metres to
    the left. A range join on buckets of the measure."""
    ends = segs.groupBy("line").agg(F.max(F.col("start") + F.col("length")).alias("total"))
    held = at.join(ends, "line").withColumn("t", F.least(F.greatest("measure", F.lit(0.0)), F.col("total"))).withColumn("_b", cell(F.col("t"), bucket))
    end = F.col("start") + F.col("length")
    spread = segs.withColumn("_b", F.explode(F.sequence(cell(F.col("start"), bucket), cell(end, bucket))))
    hit = held.join(spread, ["line", "_b"]).where((F.col("t") <= end) & ((F.col("start") < F.col("t")) | (F.col("seq") == 0)))
    dx, dz, length = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az"), F.nullif(F.col("length"), F.lit(0.0))
    f, left = F.coalesce((F.col("t") - F.col("start")) / length, F.lit(0.0)), F.coalesce(F.col("offset") / length, F.lit(0.0))
    return hit.select("id", "line", "measure", "offset", (F.col("ax") + f * dx + left * dz).alias("x"), (F.col("az") + f * dz - left * dx).alias("z"), F.atan2(dx, dz).alias("heading"))


def _names_with(names: DataFrame, streets: DataFrame) -> DataFrame:
    """street, name: the distinct names (name) that contain each of the distinct streets (street), those of no letters apart. An
    equal join on the pieces of names that are as long as a street."""
    lengths = F.broadcast(streets.select(F.length("street").alias("_n")).where("_n > 0").distinct())  # at most the longest street's
    places = names.join(lengths, F.length("name") >= F.col("_n")).withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("_n") + 1)))
    return places.select("name", F.substring(F.col("name"), F.col("_at"), F.col("_n")).alias("street")).distinct().join(streets, "street").select("street", "name")


def _apart(x: np.ndarray, z: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of points to the straight lines from p to q, (x or z, pair) in."""
    dx, dz = q - p
    square = dx * dx + dz * dz
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(square > 0, np.clip(((x - p[0]) * dx + (z - p[1]) * dz) / square, 0.0, 1.0), 0.0)
        return np.sqrt((x - p[0] - t * dx) ** 2 + (z - p[1] - t * dz) ** 2)


def _length(dx: np.ndarray, dz: np.ndarray) -> np.ndarray:
    length = np.hypot(dx, dz)
    return np.where(length == 0, 1.0, length)


def _covered(ends: np.ndarray, points: np.ndarray, both: np.ndarray, distance: float) -> np.ndarray:
    """Which edges, ends (x or z, first or middle or last, pair), run along the lines through points (x or z, point, pair): near
    them at the middle and the end, and in their direction unless both are meant."""
    (x0, _, x1), (z0, _, z1) = ends
    dx, dz, x, z = x1 - x0, z1 - z0, x0 / 2 + x1 / 2, z0 / 2 + z1 / 2
    near = np.zeros((2, len(x)), dtype=bool)
    least, along = np.full(len(x), np.inf), np.zeros(len(x))
    for p, q in zip(points.swapaxes(0, 1), points.swapaxes(0, 1)[1:], strict=False):
        near |= [_apart(*ends[:, k], p, q) <= distance for k in (1, 2)]
        d, (sx, sz) = _apart(x, z, p, q), q - p
        closer = d < least
        least, along = np.where(closer, d, least), np.where(closer, (dx * sx + dz * sz) / _length(sx, sz), along)
    return near.all(axis=0) & (both | (along / _length(dx, dz) >= 0.5))


def match_drawn(lines: DataFrame, edges: DataFrame, distance: float = 20.0, stop: tuple[str, ...] = ("ulica", "cesta", "avenija", "trg")) -> DataFrame:
    """line, edge: the edges that a drawn line covers, all along, in its direction, on the street it names.

    lines: line, points, street (NULL or empty: any), both_ways; edges: edge, points, name. An edge's first, middle and last
    points must lie within distance of the line; unless both ways are meant, its chord must run within 60 degrees of the
    line where that passes nearest to the chord's middle. Lines of one point cover nothing.

    An edge meets the lines of its own street in the cell of its first point; what is near there is judged at once, in numpy.
    """
    n, size = F.size("points"), 4 * distance
    spots = {"0": F.col("points")[0], "m": F.get("points", F.floor(n / 2).cast("int")), "1": F.element_at("points", -1)}
    ends = edges.where(n > 1).select("edge", _street(F.col("name"), stop).alias("name"), *[p[c].alias(f"{c}{k}") for k, p in spots.items() for c in "xz"])
    drawn = lines.where(n > 1).withColumn("street", _street(F.col("street"), stop))
    # lines that name no street meet all edges under an empty name
    keyed = ends.withColumn("_street", F.explode(F.array_distinct(F.array("name", F.lit(""))))).withColumns({"_cx": cell(F.col("x0"), size), "_cz": cell(F.col("z0"), size)})
    named = drawn.join(_names_with(ends.select("name").distinct(), drawn.select("street").distinct()), "street", "left")
    named = named.withColumn("_street", F.when(F.col("street") == "", "").otherwise(F.col("name"))).where("_street is not null")
    box = [(f(F.col(f"points.{c}")) + step).alias(f"{k}{c}") for c in "xz" for k, f, step in (("low_", F.array_min, -distance), ("high_", F.array_max, distance))]
    sides = F.zip_with(F.slice("points", 1, n - 1), F.slice("points", 2, n - 1), lambda p, q: F.struct(p["x"].alias("ax"), p["z"].alias("az"), q["x"].alias("bx"), q["z"].alias("bz")))
    flat = F.flatten(F.transform("points", lambda p: F.array(p["x"], p["z"])))
    parts = named.select("line", "both_ways", "_street", flat.alias("points"), *box, F.explode(sides).alias("s")).select("*", "s.*").drop("s")
    parts = _in_cells(parts.where(" and ".join(f"abs({c}) < double('infinity')" for c in _ENDS)), size, distance)
    near = [F.col(f"{c}{k}").between(F.col(f"low_{c}"), F.col(f"high_{c}")) for k in "1m" for c in "xz"]
    met = keyed.join(parts, ["_cx", "_cz", "_street"]).where(reduce(lambda a, b: a & b, near)).where(segment_distance(F.col("x0"), F.col("z0"), *(F.col(c) for c in _ENDS)) <= distance)
    names = [f"{c}{k}" for c in "xz" for k in spots]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).reshape(2, 3, -1)
            both = pc.fill_null(batch.column("both_ways"), False).to_numpy(zero_copy_only=False)
            flat, sizes = batch.column("points").flatten().to_numpy(zero_copy_only=False), pc.list_value_length(batch.column("points")).to_numpy(zero_copy_only=False)
            starts, kept = np.cumsum(sizes) - sizes, np.zeros(len(batch), dtype=bool)
            for k in np.unique(sizes):
                rows = np.flatnonzero(sizes == k)
                kept[rows] = _covered(at[:, :, rows], flat[np.arange(k).reshape(-1, 2).T[:, :, None] + starts[rows]], both[rows], distance)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(kept)) for c in ("line", "edge")], ["line", "edge"])

    kinds = dict(lines.dtypes)["line"], dict(edges.dtypes)["edge"]
    return met.select("line", "edge", "both_ways", "points", *names).mapInArrow(judged, f"line {kinds[0]}, edge {kinds[1]}").distinct()


def crossings(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """a, b, x, z: the points where segments of line a and line b meet; of segments that lie on one line, the ends of what
    they share. Both sides: as segments() gives them; size: of the cells, near the length of a usual segment."""
    left = _in_cells(a.select(F.col("line").alias("a"), *_ENDS), size, 0.0)
    right = _in_cells(b.select(F.col("line").alias("b"), *_ENDS), size, 0.0).withColumnsRenamed({n: f"o_{n}" for n in _ENDS})
    met = left.join(right, ["_cx", "_cz"])
    dx, dz, ox, oz = F.col("bx") - F.col("ax"), F.col("bz") - F.col("az"), F.col("o_bx") - F.col("o_ax"), F.col("o_bz") - F.col("o_az")
    gx, gz = F.col("o_ax") - F.col("ax"), F.col("o_az") - F.col("az")
    turn = F.nullif(dx * oz - dz * ox, F.lit(0.0))
    t, u = (gx * oz - gz * ox) / turn, (gx * dz - gz * dx) / turn
    point = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    at = F.array(point(F.col("ax") + t * dx, F.col("az") + t * dz))
    mine, other = [F.col(n) for n in _ENDS], [F.col(f"o_{n}") for n in _ENDS]
    shared = [F.when(segment_distance(*p, *o) == 0, point(*p)) for p, o in ((mine[:2], other), (mine[2:], other), (other[:2], mine), (other[2:], mine))]
    found = F.when(turn.isNull(), F.array_compact(F.array(*shared))).when(t.between(0, 1) & u.between(0, 1), at)
    return met.select("a", "b", F.explode(found).alias("p")).select("a", "b", "p.x", "p.z").distinct()


def assign_counts(gateways: DataFrame, sections: DataFrame, boundary: DataFrame, crossing: float = 10_000.0, near: float = 2_500.0, size: float = 1_000.0) -> DataFrame:
    """id, station, tier, dist, daily: each gateway with the counted section of its road that crosses the boundary nearest to
    it, within crossing (tier 1), else that lies nearest to where the road leaves, within near (tier 2), else none. Gateways
    that share a section share its count.

    gateways: id, x, z, roads (array; a road may be a family such as 'A*'); sections: station, roads (array), points, daily;
    boundary: line, points (closed). The smaller station wins a tie.
    """
    from urbanspark.sources.tables import stored

    mine = gateways.select("id", "x", "z", F.explode("roads").alias("road")).distinct()
    theirs = sections.select("station", F.explode("roads").alias("road")).distinct()
    edge, segs = segments(boundary), segments(sections.select(F.col("station").alias("line"), "points"))
    cut = crossings(segs, edge, size).select(F.col("a").alias("station"), "x", "z").join(theirs, "station")
    # the nearest cut of a road by cells, as a road may have many gateways and sections
    cuts = nearest(mine, cut.withColumnRenamed("station", "id"), crossing, on=("road",), digits=None)
    first = stored(cuts.where("nearest is not null").groupBy("id").agg(F.min(F.struct(F.col("dist").alias("d"), F.col("nearest").alias("station"))).alias("first")), "crossed")
    others = stored(gateways.join(first, "id", "left_anti").select("id", "x", "z", "roads"), "others")
    leaving = interpolate(project(others, edge, crossing).withColumn("offset", F.lit(0.0)), edge).select("id", "x", "z")
    led = leaving.join(others.select("id", F.explode("roads").alias("road")).distinct(), "id")
    close = nearest_segments(led, segs.join(theirs.withColumnRenamed("station", "line"), "line"), near, ("road",))
    second = close.groupBy("id").agg(F.min(F.struct(F.col("dist").alias("d"), F.col("line").alias("station"))).alias("second"))
    best = gateways.select("id").join(first, "id", "left").join(second, "id", "left")
    chosen = F.coalesce("first", "second")
    best = best.select("id", chosen["station"].alias("station"), F.when(F.col("first").isNotNull(), 1).when(F.col("second").isNotNull(), 2).alias("tier"), chosen["d"].alias("dist"))
    users = best.where("station is not null").groupBy("station").agg(F.count("*").alias("users"))
    daily = sections.select("station", "daily").join(users, "station").select("station", (F.col("daily") / F.col("users")).alias("daily"))
    return best.join(daily, "station", "left").select("id", "station", "tier", "dist", "daily")
