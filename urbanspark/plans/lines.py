"""Lines: positions along them, drawn lines on edges, lines over a boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.operators.lines import assign_counts, crossings, interpolate, match_drawn, project, segments
from urbanspark.registry import query
from urbanspark.sources.views import VIEWS

_SEGMENTS = (
    "segs AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY line ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ("
    "SELECT edge AS line, CAST(k - 1 AS INTEGER) AS seq, points[k].x AS ax, points[k].z AS az, points[k + 1].x AS bx, points[k + 1].z AS bz, sqrt(pow(points[k + 1].x - points[k].x, 2) + pow(points[k + 1].z - points[k].z, 2)) AS length "
    "FROM v_shape, unnest(range(1, len(points))) AS t(k)))"
)
_T = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({x} - ax) * (bx - ax) + ({z} - az) * (bz - az)) / nullif(length * length, 0)))"


def _to_segment(x: str, z: str) -> str:
    t = _T.format(x=x, z=z)
    return f"sqrt(pow({x} - ax - {t} * (bx - ax), 2) + pow({z} - az - {t} * (bz - az), 2))"


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    return segments(VIEWS["v_shape"](spark, d).select(F.col("edge").alias("line"), "points"))


@query(f"WITH {_SEGMENTS} SELECT line, seq, round(start, 6) AS start, round(length, 6) AS length FROM segs")
def measured_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments of all edges with the metres before them."""
    return _shapes(spark, d).select("line", "seq", F.round("start", 6).alias("start"), F.round("length", 6).alias("length"))


@query(
    f"WITH {_SEGMENTS}, spots AS (SELECT line, k, greatest(0, least(total, total * k / 4.0 - 10)) AS t FROM (SELECT line, sum(length) AS total FROM segs GROUP BY 1), unnest(range(0, 6)) AS u(k)) "
    "SELECT a.line, a.k, round(ax + (t - start) / length * (bx - ax) + 3 / length * (bz - az), 5) AS x, round(az + (t - start) / length * (bz - az) - 3 / length * (bx - ax), 5) AS z, round(atan2(bx - ax, bz - az), 6) AS heading "
    "FROM spots a ASOF JOIN (SELECT *, start + length AS stop FROM segs) s ON a.line = s.line AND a.t <= s.stop"
)
def positions_along_lines(spark: SparkSession, d: str) -> DataFrame:
    """Where vehicles at five measures of each edge stand, 3 m to the left of its line."""
    segs = _shapes(spark, d)
    total = segs.groupBy("line").agg(F.sum("length").alias("total"))
    at = total.select("line", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("k"))
    at = at.select(F.struct("line", "k").alias("id"), "line", (F.col("total") * F.col("k") / 4.0 - 10).alias("measure"), F.lit(3.0).alias("offset"))
    return interpolate(at, segs).select("line", "id.k", F.round("x", 5).alias("x"), F.round("z", 5).alias("z"), F.round("heading", 6).alias("heading"))


@query(
    f"WITH {_SEGMENTS} SELECT id, line, round(start + {_T.format(x='x', z='z')} * length, 4) AS measure, round(CASE WHEN (x - ax) * (bz - az) - (z - az) * (bx - ax) < 0 THEN -d ELSE d END, 4) AS offset_m "
    f"FROM (SELECT p.id, p.x, p.z, s.*, {_to_segment('p.x', 'p.z')} AS d FROM (SELECT id, x + 40 AS x, z - 25 AS z FROM v_point) p, segs s) WHERE d <= 60 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, line, seq) = 1"
)
def places_on_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each place, moved aside, put on the nearest edge within 60 m: how far along it and how far to its left."""
    points = VIEWS["v_point"](spark, d).select("id", (F.col("x") + 40).alias("x"), (F.col("z") - 25).alias("z"))
    return project(points, _shapes(spark, d), 60.0).select("id", "line", F.round("measure", 4).alias("measure"), F.round("offset", 4).alias("offset_m"))


_DRAWN = "drawn AS (SELECT a.edge AS line, a.name AS street, a.edge % 2 = 0 AS both_ways, [{'x': a.points[1].x + 8, 'z': a.points[1].z - 6}, {'x': a.points[3].x + 8, 'z': a.points[3].z - 6}, {'x': b.points[3].x, 'z': b.points[3].z}] AS points FROM v_shape a JOIN v_shape b ON b.edge = a.edge + 2 WHERE a.edge % 5 < 3)"
_PROBES = "probes AS (SELECT edge, name, points, points[k].x AS x, points[k].z AS z, k FROM v_shape, unnest([1, 2, 3]) AS t(k))"
_SIDES = "sides AS (SELECT line, k AS seq, points[k].x AS ax, points[k].z AS az, points[k + 1].x AS bx, points[k + 1].z AS bz, sqrt(pow(points[k + 1].x - points[k].x, 2) + pow(points[k + 1].z - points[k].z, 2)) AS length FROM drawn, unnest([1, 2]) AS t(k))"
_NAME = "trim(regexp_replace(regexp_replace(lower(coalesce({}, '')), '\\b(ulica|cesta|avenija|trg)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"WITH {_DRAWN}, {_PROBES}, {_SIDES}, near AS (SELECT line, edge, k, min({_to_segment('p.x', 'p.z')}) AS d FROM probes p, sides s GROUP BY ALL), "
    "along AS (SELECT line, edge FROM near GROUP BY ALL HAVING bool_and(d <= 20)), "
    f"turned AS (SELECT a.line, a.edge, ((e.points[3].x - e.points[1].x) * (bx - ax) + (e.points[3].z - e.points[1].z) * (bz - az)) / length / sqrt(pow(e.points[3].x - e.points[1].x, 2) + pow(e.points[3].z - e.points[1].z, 2)) AS c "
    f"FROM along a JOIN v_shape e USING (edge) JOIN sides s USING (line) QUALIFY row_number() OVER (PARTITION BY a.line, a.edge ORDER BY {_to_segment('(e.points[1].x + e.points[3].x) / 2', '(e.points[1].z + e.points[3].z) / 2')}, s.seq) = 1) "
    f"SELECT t.line, t.edge FROM turned t JOIN drawn d USING (line) JOIN v_shape e USING (edge) WHERE (both_ways OR c >= 0.5) AND contains({_NAME.format('e.name')}, {_NAME.format('d.street')})"
)
def drawn_lines_on_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges that drawn closures cover: near all along, in their direction, on their street."""
    shapes = VIEWS["v_shape"](spark, d)
    point = lambda p, dx, dz: F.struct((p["x"] + dx).alias("x"), (p["z"] + dz).alias("z"))
    following = shapes.select((F.col("edge") - 2).alias("edge"), F.col("points")[2].alias("far"))
    drawn = shapes.where("edge % 5 < 3").join(following, "edge").select(
        F.col("edge").alias("line"), F.col("name").alias("street"), (F.col("edge") % 2 == 0).alias("both_ways"), F.array(point(F.col("points")[0], 8.0, -6.0), point(F.col("points")[2], 8.0, -6.0), "far").alias("points")
    )
    return match_drawn(drawn, shapes)


# a square of 600 m about the origin, closed
_RING = [(-600.0, -600.0), (600.0, -600.0), (600.0, 600.0), (-600.0, 600.0), (-600.0, -600.0)]
_OUTLINE = "ring AS (SELECT * FROM (VALUES " + ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE, 1200.0::DOUBLE)" for a, b in zip(_RING, _RING[1:], strict=False)) + ") t(cx, cz, ex, ez, side))"
_U, _V = "((cx - ax) * (ez - cz) - (cz - az) * (ex - cx))", "((cx - ax) * (bz - az) - (cz - az) * (bx - ax))"
_TURN = "((bx - ax) * (ez - cz) - (bz - az) * (ex - cx))"
_CUT = f"cut AS (SELECT DISTINCT line, ax + u * (bx - ax) AS x, az + u * (bz - az) AS z FROM (SELECT *, {_U} / nullif({_TURN}, 0) AS u, {_V} / nullif({_TURN}, 0) AS v FROM segs, ring) WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1)"


def _outline(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, [{"x": x, "z": z} for x, z in _RING])], "line int, points array<struct<x double, z double>>")


@query(f"WITH {_SEGMENTS}, {_OUTLINE}, {_CUT} SELECT line, round(x, 4) AS x, round(z, 4) AS z FROM cut")
def lines_over_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Where edges cross the outline of an area."""
    found = crossings(_shapes(spark, d), segments(_outline(spark)), 500.0)
    return found.select(F.col("a").alias("line"), F.round("x", 4).alias("x"), F.round("z", 4).alias("z"))


_GATES = "gates AS (SELECT id, x, z, 'A' || kind AS road FROM v_point WHERE greatest(abs(x), abs(z)) > 600)"
_RING_AT = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((g.x - cx) * (ex - cx) + (g.z - cz) * (ez - cz)) / (side * side)))"


@query(
    f"WITH {_SEGMENTS}, {_OUTLINE}, {_CUT}, {_GATES}, roads AS (SELECT edge AS station, 'A' || (edge % 10) AS road, 1000.0 + edge AS daily FROM v_shape), "
    "first AS (SELECT g.id, r.station, sqrt(pow(c.x - g.x, 2) + pow(c.z - g.z, 2)) AS d FROM gates g JOIN roads r USING (road) JOIN cut c ON c.line = r.station WHERE d <= 400 QUALIFY row_number() OVER (PARTITION BY g.id ORDER BY d, r.station) = 1), "
    f"leaving AS (SELECT id, road, cx + t * (ex - cx) AS x, cz + t * (ez - cz) AS z FROM (SELECT g.*, r.*, {_RING_AT} AS t FROM gates g, ring r) WHERE sqrt(pow(x - cx - t * (ex - cx), 2) + pow(z - cz - t * (ez - cz), 2)) <= 400 "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY sqrt(pow(x - cx - t * (ex - cx), 2) + pow(z - cz - t * (ez - cz), 2)), cz, cx) = 1), "
    f"second AS (SELECT l.id, r.station, {_to_segment('l.x', 'l.z')} AS d FROM leaving l JOIN roads r USING (road) JOIN segs s ON s.line = r.station WHERE {_to_segment('l.x', 'l.z')} <= 150 QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY d, r.station) = 1), "
    "best AS (SELECT g.id, coalesce(f.station, s.station) AS station, CASE WHEN f.id IS NOT NULL THEN 1 WHEN s.id IS NOT NULL THEN 2 END AS tier, coalesce(f.d, s.d) AS d FROM gates g LEFT JOIN first f ON f.id = g.id LEFT JOIN second s ON s.id = g.id) "
    "SELECT id, b.station, tier, round(d, 4) AS dist, round(daily / count(*) OVER (PARTITION BY b.station), 6) AS daily FROM best b LEFT JOIN roads r ON r.station = b.station"
)
def gateway_counts(spark: SparkSession, d: str) -> DataFrame:
    """The daily count at each gateway: of its road's counted section that crosses the outline near it, else lies near it."""
    gates = VIEWS["v_point"](spark, d).where("greatest(abs(x), abs(z)) > 600").select("id", "x", "z", F.array(F.concat(F.lit("A"), F.col("kind").cast("string"))).alias("roads"))
    road = F.concat(F.lit("A"), (F.col("edge") % 10).cast("string"))
    sections = VIEWS["v_shape"](spark, d).select(F.col("edge").alias("station"), F.array(road).alias("roads"), "points", (1000.0 + F.col("edge")).alias("daily"))
    out = assign_counts(gates, sections, _outline(spark), 400.0, 150.0, 500.0)
    return out.select("id", "station", "tier", F.round("dist", 4).alias("dist"), F.round("daily", 6).alias("daily"))
