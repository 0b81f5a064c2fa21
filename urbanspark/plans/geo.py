"""Points, polygons, nearest neighbours, catchments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanspark.functions.formulas import noise_loss, road_noise
from urbanspark.operators.sequences import beside
from urbanspark.operators.spatial import catchment, cell, deduplicate_places, kernel_allocation, nearest, nearest_heading, point_in_nearest_polygon, point_in_polygon, within
from urbanspark.registry import query
from urbanspark.sources.views import VIEWS

_D = "sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2))"


def _points(spark: SparkSession, d: str, kinds: str) -> DataFrame:
    return VIEWS["v_point"](spark, d).where(kinds)


@query(f"SELECT a.id AS a, b.id AS b, round({_D}, 4) AS dist FROM v_point a JOIN v_point b ON a.kind = 0 AND b.kind = 1 AND pow(a.x - b.x, 2) + pow(a.z - b.z, 2) <= 90000")
def distance_within(spark: SparkSession, d: str) -> DataFrame:
    pairs = within(_points(spark, d, "kind = 0"), _points(spark, d, "kind = 1"), 300.0)
    return pairs.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.round("dist", 4).alias("dist"))


@query(f"SELECT a.id, arg_min(b.id, row(b.kind <> 1, round({_D}, 6), b.id)) AS nearest FROM v_point a LEFT JOIN v_point b ON b.kind IN (1, 2) AND {_D} <= 300 WHERE a.kind = 0 GROUP BY 1")
def nearest_with_tier(spark: SparkSession, d: str) -> DataFrame:
    """The nearest point of kind 1, else of kind 2, within 300 m."""
    out = nearest(_points(spark, d, "kind = 0"), _points(spark, d, "kind in (1, 2)"), 300.0, F.when(F.col("r_kind") == 1, 0).otherwise(1))
    return out.select("id", "nearest")


@query(f"SELECT a.id, arg_min(b.id, row(round({_D}, 6), b.id)) AS nearest FROM (SELECT *, (id * 37) % 360 AS h FROM v_point WHERE kind = 0) a LEFT JOIN (SELECT *, (id * 53) % 360 AS h FROM v_point WHERE kind = 1) b ON {_D} <= 400 AND least(((a.h - b.h) % 360 + 360) % 360, 360 - ((a.h - b.h) % 360 + 360) % 360) <= 60 GROUP BY 1")
def nearest_with_heading(spark: SparkSession, d: str) -> DataFrame:
    """The nearest point that heads the same way, give or take 60 degrees."""
    a = _points(spark, d, "kind = 0").withColumn("heading", ((F.col("id") * 37) % 360).cast("double"))
    b = _points(spark, d, "kind = 1").withColumn("heading", ((F.col("id") * 53) % 360).cast("double"))
    return nearest_heading(a, b, 400.0, 60.0).select("id", "nearest")


_RING = [(-900.0, -900.0), (900.0, -700.0), (1100.0, 800.0), (0.0, 200.0), (-800.0, 1000.0)]


def _crossings(ring: list[tuple[float, float]]) -> str:
    return " + ".join(f"(CASE WHEN (({az}::DOUBLE > z) <> ({bz}::DOUBLE > z)) AND x < {ax}::DOUBLE + (z - ({az}::DOUBLE)) / ({bz - az}::DOUBLE) * ({bx - ax}::DOUBLE) THEN 1 ELSE 0 END)" for (ax, az), (bx, bz) in zip(ring, [*ring[1:], ring[0]], strict=True))


@query(f"SELECT id, CASE WHEN ({_crossings(_RING)}) % 2 = 1 THEN 'core' WHEN abs(x) <= 1500 AND abs(z) <= 1500 AND x > -1500 AND z > -1500 AND x < 1500 AND z < 1500 THEN 'ring' END AS polygon FROM v_point")
def point_in_polygon_zone(spark: SparkSession, d: str) -> DataFrame:
    """The innermost of two overlapping polygons that holds a point."""
    square = [(-1500.0, -1500.0), (1500.0, -1500.0), (1500.0, 1500.0), (-1500.0, 1500.0)]
    rows = [("core", 1, _RING), ("ring", 2, square)]
    polygons = spark.createDataFrame(rows, "polygon string, priority int, ring array<struct<x: double, z: double>>")
    return point_in_polygon(VIEWS["v_point"](spark, d), polygons, 500.0).select("id", "polygon")


@query("SELECT kind, round(abs(sum(a.x * b.z - b.x * a.z)) / 2, 4) AS area FROM (SELECT kind, x, z, row_number() OVER (PARTITION BY kind ORDER BY id) AS r, count(*) OVER (PARTITION BY kind) AS n FROM v_point) a JOIN (SELECT kind AS k2, x, z, row_number() OVER (PARTITION BY kind ORDER BY id) AS r FROM v_point) b ON kind = k2 AND b.r = a.r % n + 1 GROUP BY 1")
def ring_area(spark: SparkSession, d: str) -> DataFrame:
    """Shoelace area of the ring through each kind's points."""
    p = beside(VIEWS["v_point"](spark, d), ["kind"], ["id"], F.floor(F.col("id") / 4096), ["x", "z"], ahead=True)
    spot = F.struct("x", "z")
    rings = p.groupBy("kind").agg(F.sum(F.col("x") * F.col("other_z") - F.col("other_x") * F.col("z")).alias("twice"), F.min_by(spot, "id").alias("a"), F.max_by(spot, "id").alias("b"))
    closed = F.coalesce("twice", F.lit(0.0)) + F.col("b.x") * F.col("a.z") - F.col("a.x") * F.col("b.z")
    return rings.select("kind", F.round(F.abs(closed) / 2, 4).alias("area"))


@query("SELECT CAST(floor(x / 500) AS BIGINT) AS cx, CAST(floor(z / 500) AS BIGINT) AS cz, round(sum(x * (1 + kind)) / sum(1 + kind), 4) AS x, round(sum(z * (1 + kind)) / sum(1 + kind), 4) AS z, arg_max(id, row(kind, -id)) AS busiest FROM v_point GROUP BY 1, 2")
def zone_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Weighted centroid and heaviest point of each cell."""
    w = 1 + F.col("kind")
    mean = lambda c: F.round(F.sum(F.col(c) * w) / F.sum(w), 4)
    p = VIEWS["v_point"](spark, d)
    return p.groupBy(cell(F.col("x"), 500).alias("cx"), cell(F.col("z"), 500).alias("cz")).agg(mean("x").alias("x"), mean("z").alias("z"), F.max_by("id", F.struct(F.col("kind"), -F.col("id"))).alias("busiest"))


@query(f"SELECT id, round(sum(v), 4) AS value FROM (SELECT b.id, (1 + a.id % 7) * k / sum(k) OVER (PARTITION BY a.id) AS v FROM (SELECT a.*, b.id AS bid, 1 - {_D} / 400 AS k FROM v_point a JOIN v_point b ON a.kind = 0 AND b.kind = 1 AND {_D} <= 400) a JOIN v_point b ON b.id = a.bid WHERE k > 0) GROUP BY 1")
def kernel_spread(spark: SparkSession, d: str) -> DataFrame:
    """Weights of kind 0 spread over points of kind 1 in 400 m, by distance."""
    src = _points(spark, d, "kind = 0").withColumn("w", 1 + F.col("id") % 7)
    return kernel_allocation(src, _points(spark, d, "kind = 1"), 400.0).groupBy(F.col("r_id").alias("id")).agg(F.round(F.sum("value"), 4).alias("value"))


_CATCH = "WITH p AS (SELECT a.id AS h, b.id AS s, 1.0 + a.id % 5 AS residents, 1.0 + b.id % 3 AS places FROM v_point a JOIN v_point b ON a.kind IN (3, 4) AND b.kind = 5 AND pow(a.x - b.x, 2) + pow(a.z - b.z, 2) <= 250000), r AS (SELECT s, any_value(places) / sum(residents) AS ratio FROM p GROUP BY 1), u AS (SELECT h, sum(ratio) AS supply FROM p JOIN r USING (s) GROUP BY 1)"


def _supply(spark: SparkSession, d: str) -> DataFrame:
    homes = _points(spark, d, "kind in (3, 4)").withColumn("residents", 1.0 + F.col("id") % 5)
    return catchment(_points(spark, d, "kind = 5").withColumn("places", 1.0 + F.col("id") % 3), homes, 500.0)


@query(f"{_CATCH} SELECT v.id, round(coalesce(u.supply, 0), 6) AS supply FROM v_point v LEFT JOIN u ON u.h = v.id WHERE v.kind IN (3, 4)")
def two_step_catchment(spark: SparkSession, d: str) -> DataFrame:
    return _supply(spark, d).select("id", F.round("supply", 6).alias("supply"))


@query(f"{_CATCH} SELECT v.kind, round(sum((1.0 + v.id % 5) * greatest(0.2 - coalesce(u.supply, 0), 0)), 4) AS shortfall, round(avg(CASE WHEN coalesce(u.supply, 0) >= 0.2 THEN 1.0 ELSE 0.0 END), 6) AS served FROM v_point v LEFT JOIN u ON u.h = v.id WHERE v.kind IN (3, 4) GROUP BY 1")
def coverage_shortfall(spark: SparkSession, d: str) -> DataFrame:
    """Places missing and share of homes served, by kind."""
    s = _supply(spark, d)
    return s.groupBy("kind").agg(F.round(F.sum(F.col("residents") * F.greatest(0.2 - F.col("supply"), F.lit(0.0))), 4).alias("shortfall"), F.round(F.avg(F.when(F.col("supply") >= 0.2, 1.0).otherwise(0.0)), 6).alias("served"))


@query(
    "WITH RECURSIVE places AS MATERIALIZED (SELECT id, kind, CASE WHEN id % 3 = 0 THEN '' ELSE 'n' || (id % 2) END AS name, x, z FROM v_point), ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY name = '', kind, name, id) AS k FROM places), "
    "twins AS MATERIALIZED (SELECT a.k, list(b.k) AS before FROM ordered a JOIN ordered b ON a.kind = b.kind AND b.k < a.k AND (a.name = '' OR a.name = b.name) AND pow(a.x - b.x, 2) + pow(a.z - b.z, 2) < 90000 GROUP BY 1), "
    "pick(k, stays, kept) AS (SELECT 0::BIGINT, false, []::BIGINT[] UNION ALL SELECT k, free, CASE WHEN free THEN list_append(kept, k) ELSE kept END FROM (SELECT o.k, p.kept, NOT list_has_any(coalesce(t.before, []), p.kept) AS free FROM pick p JOIN ordered o ON o.k = p.k + 1 LEFT JOIN twins t ON t.k = o.k)) "
    "SELECT id, kind FROM pick JOIN ordered USING (k) WHERE stays"
)
def dedupe_by_cell(spark: SparkSession, d: str) -> DataFrame:
    """Places that stay of those mapped twice: of one kind, less than 300 m apart, of one name or unnamed; across cell borders."""
    name = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("n"), (F.col("id") % 2).cast("string")))
    return deduplicate_places(VIEWS["v_point"](spark, d).withColumn("name", name), 300.0).select("id", "kind")


@query("SELECT b.id, CAST(arg_max(s.kind, row(s.id)) AS INTEGER) AS painted FROM v_point b JOIN v_point s ON b.kind = 6 AND s.kind IN (7, 8) AND pow(s.x - b.x, 2) + pow(s.z - b.z, 2) <= 62500 GROUP BY 1")
def brush_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Strokes paint what they reach; the last one stays."""
    pairs = within(_points(spark, d, "kind = 6"), _points(spark, d, "kind in (7, 8)"), 250.0)
    return pairs.groupBy(F.col("l_id").alias("id")).agg(F.max_by("r_kind", "r_id").cast("int").alias("painted"))


@query("SELECT edge_id, round(db, 6) AS db, round(least(greatest((db - 55) * 0.006, 0), 0.25), 6) AS loss FROM (SELECT edge_id, 39.2 + 10 * log10(greatest(n, 1)) - 10 * log10(greatest(length / 50, 1) / 10) AS db FROM (SELECT edge_id, CAST(count(*) AS DOUBLE) AS n FROM v_pass GROUP BY 1) JOIN v_edge USING (edge_id))")
def road_noise_loss(spark: SparkSession, d: str) -> DataFrame:
    n = VIEWS["v_pass"](spark, d).groupBy("edge_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    db = n.join(VIEWS["v_edge"](spark, d), "edge_id").withColumn("db", road_noise(F.col("n"), F.col("length") / 50))
    return db.select("edge_id", F.round("db", 6).alias("db"), F.round(noise_loss(F.col("db")), 6).alias("loss"))


@query("SELECT id, n1, round(h, 4) AS heading FROM (SELECT id, lead(id) OVER (PARTITION BY kind ORDER BY id) AS n1, degrees(atan2(lead(z) OVER (PARTITION BY kind ORDER BY id) - z, lead(x) OVER (PARTITION BY kind ORDER BY id) - x)) AS h FROM v_point) WHERE n1 IS NOT NULL")
def neighbour_heading(spark: SparkSession, d: str) -> DataFrame:
    """The next point of the same line and the way to it."""
    p = beside(VIEWS["v_point"](spark, d), ["kind"], ["id"], F.floor(F.col("id") / 4096), ["id", "x", "z"], ahead=True)
    h = F.degrees(F.atan2(F.col("other_z") - F.col("z"), F.col("other_x") - F.col("x")))
    return p.where("other_id is not null").select("id", F.col("other_id").alias("n1"), F.round(h, 4).alias("heading"))


_BOXES = (("north", 100.0, 100.0, 700.0, 900.0), ("south", -900.0, -900.0, -100.0, -100.0))
_OFF = "sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(z0 - z, 0, z - z1), 2))"


@query(
    "WITH boxes(polygon, x0, z0, x1, z1) AS (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for n, a, b, c, e in _BOXES) + "), "
    f"near AS (SELECT id, arg_min(polygon, {_OFF}) AS polygon FROM v_point, boxes WHERE {_OFF} <= 300 GROUP BY 1) SELECT p.id, polygon FROM v_point p LEFT JOIN near USING (id)"
)
def nearest_polygon_zone(spark: SparkSession, d: str) -> DataFrame:
    """The polygon that holds a point, else the one with the nearest edge within 300 m."""
    rows = [(n, 1, [(a, b), (c, b), (c, e), (a, e)]) for n, a, b, c, e in _BOXES]
    polygons = spark.createDataFrame(rows, "polygon string, priority int, ring array<struct<x: double, z: double>>")
    return point_in_nearest_polygon(VIEWS["v_point"](spark, d), polygons, 500.0, 300.0).select("id", "polygon")
