"""Grids and areas: accessibility and land value, box sums, polygon overlaps, traced boundaries, times between places on edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.functions.formulas import noise_loss, road_noise
from urbanspark.operators.grids import between_cells, blended, box_sums, cell_sources, land_value, smoothed
from urbanspark.operators.journeys import between_fractions, traced_boundary
from urbanspark.operators.polygons import overlaps
from urbanspark.operators.spatial import cell
from urbanspark.plans.timetable import ride_arcs
from urbanspark.registry import query
from urbanspark.sources.views import VIEWS, table

ACCESS_CELL = 300.0

_ACCESS = (
    "lots AS (SELECT id, x, z, kind, CASE WHEN id % 9 > 0 THEN id % 50 END AS edge, CAST(floor(x / 300) AS BIGINT) AS cx, CAST(floor(z / 300) AS BIGINT) AS cz FROM v_point), "
    "driven AS (SELECT edge_id, count(*) FILTER (pass_id % 2 = 0) AS m1, nullif(count(*) FILTER (pass_id % 3 = 1), 0) AS m2 FROM v_pass GROUP BY 1), "
    "sources AS (SELECT cx, cz, edge FROM lots WHERE edge IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cx, cz ORDER BY sqrt(pow(x - (cx + 0.5) * 300, 2) + pow(z - (cz + 0.5) * 300, 2)), id) = 1), "
    "cells AS (SELECT cx, cz, m1, coalesce(0.5::DOUBLE * m2 + 0.5::DOUBLE * m1, m2, m1) AS value FROM sources LEFT JOIN driven ON edge_id = edge), "
    "spots AS (SELECT id, x / 300 - 0.5 AS fx, z / 300 - 0.5 AS fz FROM lots), corners AS (SELECT id, floor(fx) + dx AS cx, floor(fz) + dz AS cz, abs(1 - dx - (fx - floor(fx))) * abs(1 - dz - (fz - floor(fz))) AS w FROM spots, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dz)), "
    "reach AS (SELECT id, sum(w * value) / sum(w) AS value FROM corners JOIN cells USING (cx, cz) WHERE w > 0 AND value IS NOT NULL GROUP BY 1)"
)


def _access(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lots, passes of each edge, the first measurement a cell, and both measurements blended."""
    lots = VIEWS["v_point"](spark, d).withColumn("edge", F.when(F.col("id") % 9 > 0, F.col("id") % 50))
    part = lambda cond: F.count(F.when(cond, 1))
    driven = VIEWS["v_pass"](spark, d).groupBy("edge_id").agg(part(F.col("pass_id") % 2 == 0).alias("m1"), F.nullif(part(F.col("pass_id") % 3 == 1), F.lit(0)).alias("m2"))
    measured = cell_sources(lots.withColumnRenamed("id", "lot"), ACCESS_CELL).join(driven, F.col("edge") == F.col("edge_id"), "left")
    first, second = (measured.select("cx", "cz", F.col(m).cast("double").alias("value")) for m in ("m1", "m2"))
    return lots, driven, first, blended(first, second)


@query(f"WITH {_ACCESS} SELECT l.id, round(r.value, 6) AS reach FROM lots l LEFT JOIN reach r USING (id)")
def accessibility_grid(spark: SparkSession, d: str) -> DataFrame:
    """Reach at every lot between the cells measured around it, two measurements blended."""
    lots, _, _, cells = _access(spark, d)
    return between_cells(lots.select("id", "x", "z"), cells, ACCESS_CELL).select("id", F.round("value", 6).alias("reach"))


@query(
    f"WITH {_ACCESS}, green AS (SELECT cx, cz, 100.0::DOUBLE * count(*) FILTER (kind < 3) / count(*) AS green FROM lots GROUP BY 1, 2) "
    "SELECT l.id, round(100 * pow(r.value / (SELECT max(m1) FROM cells), 0.75) * (1 + 0.1 * g.green / 100) * (1 - least(greatest((39.2 + 10 * log10(greatest(coalesce(m1, 0) / 2.0, 1)) - 10 * log10(1.2) - 55) * 0.006, 0), 0.25)), 6) AS value "
    "FROM lots l JOIN green g USING (cx, cz) LEFT JOIN reach r USING (id) LEFT JOIN driven ON edge_id = l.edge"
)
def land_value_index(spark: SparkSession, d: str) -> DataFrame:
    """Land value of lots from reach, green land in their cell and the noise of their street."""
    lots, driven, first, cells = _access(spark, d)
    keyed = lots.withColumns({"cx": cell(F.col("x"), ACCESS_CELL), "cz": cell(F.col("z"), ACCESS_CELL)})
    green = keyed.groupBy("cx", "cz").agg((100.0 * F.count_if(F.col("kind") < 3) / F.count("*")).alias("green"))
    reached = between_cells(keyed.select("id", "x", "z", "cx", "cz", "edge"), cells, ACCESS_CELL).join(green, ["cx", "cz"]).join(driven, F.col("edge") == F.col("edge_id"), "left")
    reference = first.agg(F.max("value")).first()[0] or 1.0
    loss = noise_loss(road_noise(F.coalesce("m1", F.lit(0)) / 2.0, F.lit(12.0)))
    none = F.lit(0.0)
    return reached.select("id", F.round(land_value(F.col("value"), F.lit(reference), F.col("green"), none, none, loss), 6).alias("value"))


@query(
    "WITH n AS (SELECT CAST(floor(x / 200) AS BIGINT) AS cx, CAST(floor(z / 200) AS BIGINT) AS cz, count(*) AS n FROM v_point GROUP BY 1, 2), "
    "raster AS (SELECT cx, cz FROM (SELECT unnest(range(min(cx), max(cx) + 1)) AS cx FROM n), (SELECT unnest(range(min(cz), max(cz) + 1)) AS cz FROM n)) "
    "SELECT r.cx, r.cz, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS n FROM raster r LEFT JOIN n ON abs(r.cx - n.cx) <= 2 AND abs(r.cz - n.cz) <= 2 GROUP BY 1, 2"
)
def sliding_box_sum(spark: SparkSession, d: str) -> DataFrame:
    """Points in the five by five cells around each cell of the raster, empty cells too."""
    n = VIEWS["v_point"](spark, d).groupBy(cell(F.col("x"), 200).alias("cx"), cell(F.col("z"), 200).alias("cz")).agg(F.count("*").alias("v"))
    return box_sums(n, 2).withColumnRenamed("v", "n")


@query("SELECT edge_id, round(list_reduce(list(kmh ORDER BY ts, pass_id), lambda a, x: a * 0.5 + x * 0.5), 4) AS smoothed FROM v_pass GROUP BY 1")
def edge_time_ewma(spark: SparkSession, d: str) -> DataFrame:
    """Exponentially smoothed speed of each edge after its last pass, folded hour by hour."""
    p = VIEWS["v_pass"](spark, d)
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    return smoothed(p, "edge_id", ["ts", "pass_id"], hour, "kmh").select("edge_id", F.round("smoothed", 4).alias("smoothed"))


_W, _H, _A = "(50.0 + 10 * kind)", "(40.0 + id % 25)", "(id % 360) * 0.017"
_CORNER = "{{'x': x + ({s} * {w}) * cos({a}) - ({t} * {h}) * sin({a}), 'z': z + ({s} * {w}) * sin({a}) + ({t} * {h}) * cos({a})}}"
_RECTS = "rects AS (SELECT id, 4 * (50.0::DOUBLE + 10 * kind) * (40.0::DOUBLE + id % 25) AS area, [" + ", ".join(_CORNER.format(s=s, t=t, w=_W, h=_H, a=_A) for s, t in ((-1, -1), (1, -1), (1, 1), (-1, 1))) + "] AS ring FROM v_point)"


@query(
    f"WITH {_RECTS}, sides AS (SELECT id, k, ring[k].x AS px, ring[k].z AS pz, ring[k % 4 + 1].x - ring[k].x AS dx, ring[k % 4 + 1].z - ring[k].z AS dz FROM rects, unnest([1, 2, 3, 4]) AS t(k)), "
    "near AS (SELECT a.id AS a, b.id AS b FROM rects a JOIN rects b ON a.id <> b.id AND pow(a.ring[1].x + a.ring[3].x - b.ring[1].x - b.ring[3].x, 2) + pow(a.ring[1].z + a.ring[3].z - b.ring[1].z - b.ring[3].z, 2) < 4 * 350 * 350), "
    "cuts AS (SELECT s.id AS a, e.id AS b, s.k, any_value(s.px * s.dz - s.pz * s.dx) AS swept, greatest(0, max(CASE WHEN turn > 0 THEN -off / turn WHEN turn = 0 AND off <= 0 THEN 2 END)) AS low, least(1, min(CASE WHEN turn < 0 THEN -off / turn END)) AS high "
    "FROM (SELECT n.a, n.b, s, e, e.dx * (s.pz - e.pz) - e.dz * (s.px - e.px) AS off, e.dx * s.dz - e.dz * s.dx AS turn FROM near n JOIN sides s ON s.id = n.a JOIN sides e ON e.id = n.b) GROUP BY 1, 2, 3), "
    "parts AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(greatest(coalesce(high, 1) - low, 0) * swept) / 2 AS shared FROM cuts GROUP BY 1, 2) "
    "SELECT a, b, round(shared / least(x.area, y.area), 5) AS share FROM parts JOIN rects x ON x.id = a JOIN rects y ON y.id = b WHERE shared >= 0.3 * least(x.area, y.area)"
)
def polygon_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of turned rectangles that share three tenths of the smaller one, and the share."""
    p = VIEWS["v_point"](spark, d)
    w, h, a = 50.0 + 10 * F.col("kind"), 40.0 + F.col("id") % 25, (F.col("id") % 360) * 0.017
    corner = lambda s, t: F.struct((F.col("x") + s * w * F.cos(a) - t * h * F.sin(a)).alias("x"), (F.col("z") + s * w * F.sin(a) + t * h * F.cos(a)).alias("z"))
    rects = p.select("id", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring"))
    share = F.col("shared") / F.least("area_a", "area_b")
    return overlaps(rects, rects, 320.0, 0.3, once=True).select("a", "b", F.round(share, 5).alias("share"))


_TRACKS = (
    "rides AS (SELECT stop AS a, nxt AS b, min(s) AS via FROM (SELECT route, stop, nxt, round(avg(nt - t_s), 4) AS s FROM (SELECT route, stop, t_s, lead(stop) OVER w AS nxt, lead(t_s) OVER w AS nt FROM v_stop_time WINDOW w AS (PARTITION BY trip ORDER BY seq)) "
    "WHERE nxt IS NOT NULL AND nxt <> stop AND (stop + nxt) % 7 = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2), arcs AS MATERIALIZED (SELECT a AS src, b AS dst, via + 40.0 + b AS cost FROM rides), "
    "pairs AS (SELECT p_partkey AS id, p_partkey % 50 AS a, p_size % 50 AS b, (p_partkey % 10) / 10.0::DOUBLE AS fa, (p_size % 8) / 8.0::DOUBLE AS fb FROM part)"
)


@query(
    f"WITH RECURSIVE {_TRACKS}, best(source, node, cost) USING KEY (source, node) AS (SELECT src, dst, min(cost) FROM arcs GROUP BY 1, 2 UNION SELECT c.source, c.node, c.cost FROM (SELECT b.source, r.dst AS node, min(b.cost + r.cost) AS cost FROM best b JOIN arcs r ON r.src = b.node GROUP BY 1, 2) c "
    "LEFT JOIN recurring.best k ON k.source = c.source AND k.node = c.node WHERE k.cost IS NULL OR c.cost < k.cost) "
    "SELECT id, round(CASE WHEN a = p.b AND fb >= fa THEN (fb - fa) * (40.0 + a) ELSE (1 - fa) * (40.0 + a) + cost - (1 - fb) * (40.0 + p.b) END, 4) AS seconds FROM pairs p LEFT JOIN best ON source = a AND node = p.b"
)
def times_between_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Shortest times between places given as shares along edges."""
    rides = ride_arcs(spark, d).where("(from_stop + to_stop) % 7 = 0").select(F.col("from_stop").alias("a"), F.col("to_stop").alias("b"), F.round("seconds", 4).alias("via"))
    edges = VIEWS["v_stop_time"](spark, d).select(F.col("stop").alias("edge"), (40.0 + F.col("stop")).alias("time")).distinct()
    pairs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("a"), (F.col("p_size") % 50).cast("long").alias("b"), ((F.col("p_partkey") % 10) / 10.0).alias("fa"), ((F.col("p_size") % 8) / 8.0).alias("fb"))
    return between_fractions(pairs, edges, rides.groupBy("a", "b").agg(F.min("via").alias("via"))).select("id", F.round("seconds", 4).alias("seconds"))


@query("SELECT row_number() OVER (ORDER BY (atan2(z - 2000, x - 2000) + 2.3561944901923453 + 6.283185307179586) % 6.283185307179586) - 1 AS seq, x, z FROM v_zone WHERE x IN (0, 4000) OR z IN (0, 4000)")
def traced_zone(spark: SparkSession, d: str) -> DataFrame:
    """The outline along the outermost streets of the grid of zones, from the south-west corner on."""
    z = VIEWS["v_zone"](spark, d)
    sides = ((0, F.col("z") == 0), (1, F.col("x") == 4000), (2, F.col("z") == 4000), (3, F.col("x") == 0))
    on = z.select("x", "z", F.explode(F.array_compact(F.array(*(F.when(cond, F.lit(k)) for k, cond in sides)))).alias("ord"))
    streets = on.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("x", "z"))).alias("points"))  # a street of the grid has as many points as zones along it
    return traced_boundary(streets)
