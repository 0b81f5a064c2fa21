"""Buildings, projections, sun, distances, attachment in tiers, lateness and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanspark.functions.formulas import ARCHETYPES, VEHICLES, WEATHER, distance_to_edge, inside, roof_shape, segment_distance, sun_elevation, transverse_mercator
from urbanspark.functions.rules import HEIGHTS, USES, ZONES, default_roof, estimated_height, planned_zone, storeys, use_shares
from urbanspark.operators.spatial import cell, nearest
from urbanspark.registry import query
from urbanspark.sources.tables import stored
from urbanspark.sources.views import VIEWS, table

_KIND = "CASE p_size % 8 WHEN 0 THEN 'house' WHEN 1 THEN 'residential' WHEN 2 THEN 'commercial' WHEN 3 THEN 'industrial' WHEN 4 THEN 'civic' WHEN 5 THEN 'minor' WHEN 6 THEN 'religious' ELSE 'other' END"
_LAND = "CASE p_partkey % 5 WHEN 0 THEN 'residential' WHEN 1 THEN 'commercial' WHEN 2 THEN 'civic' WHEN 3 THEN 'industrial' END"
_BUILDINGS = f"SELECT p_partkey AS id, {_KIND} AS kind, {_LAND} AS land, p_retailprice * 1.5 AS area, p_size * 0.7 AS eave, CASE WHEN p_partkey % 3 = 0 THEN p_size % 9 ELSE 0 END AS levels, p_partkey % 11 = 0 AS centre FROM part"


def _buildings(spark: SparkSession, d: str) -> DataFrame:
    """Parts seen as buildings: kind, land use (NULL: none), area, eave, mapped levels, old centre."""
    size, key = F.col("p_size"), F.col("p_partkey")
    kinds = ("house", "residential", "commercial", "industrial", "civic", "minor", "religious", "other")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (size % 8 + 1).cast("int"))
    land = F.get(F.array(*map(F.lit, ("residential", "commercial", "civic", "industrial"))), (key % 5).cast("int"))
    levels = F.when(key % 3 == 0, size % 9).otherwise(0)
    return table(spark, d, "part").select(key.alias("id"), kind.alias("kind"), land.alias("land"), (F.col("p_retailprice") * 1.5).alias("area"), (size * F.lit(0.7)).alias("eave"), levels.alias("levels"), (key % 11 == 0).alias("centre"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in row) + ")" for row in rows)


def _steps(table: dict) -> str:
    return _values((k, least, v) for k, row in table.items() for least, v in row)


@query(
    f"WITH uses(k, h, w) AS (VALUES {_values((k, *v) for k, v in USES.items())}), b AS (SELECT *, CASE WHEN area >= 2000 AND eave <= 15 THEN ' hall' END AS hall FROM ({_BUILDINGS})), "
    "found AS (SELECT b.*, h, w FROM b JOIN uses ON k IN (kind || ' ' || land, kind || hall, kind, '') QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_position([kind || ' ' || land, kind || hall, kind, ''], k)) = 1), "
    "mixed AS (SELECT *, h > 0 AND (centre OR (kind IN ('house', 'residential') AND coalesce(land = 'commercial', false))) AS m FROM found) "
    "SELECT id, CASE WHEN levels > 0 THEN levels ELSE greatest(1, round_even((eave / 3.0)::DOUBLE, 0)) END::DOUBLE AS storeys, round(CASE WHEN m THEN least(h, 0.7) ELSE h END, 4) AS home, round(CASE WHEN m THEN greatest(w, 0.3) ELSE w END, 4) AS work FROM mixed"
)
def storeys_and_shares(spark: SparkSession, d: str) -> DataFrame:
    """Storeys of buildings, and the shares of their floors for living and for work."""
    home, work = use_shares(F.col("kind"), F.col("land"), F.col("area"), F.col("eave"), F.col("centre"))
    return _buildings(spark, d).select("id", storeys(F.col("levels"), F.col("eave")).alias("storeys"), F.round(home, 4).alias("home"), F.round(work, 4).alias("work"))


@query(
    f"WITH heights(k, least_area, h) AS (VALUES {_steps(HEIGHTS)}), b AS (SELECT * REPLACE (area / 8 AS area) FROM ({_BUILDINGS})), "
    "sized AS (SELECT b.*, CASE WHEN levels > 0 THEN levels * 3.0 + 1.0 ELSE h END::DOUBLE AS height FROM b JOIN heights ON k = CASE WHEN kind IN (SELECT k FROM heights) THEN kind ELSE '' END AND least_area <= area QUALIFY row_number() OVER (PARTITION BY id ORDER BY least_area DESC) = 1) "
    "SELECT id, round(height, 4) AS height, CASE WHEN kind IN ('house', 'other', 'minor') AND area < 300 AND height <= 10 THEN 'gabled' ELSE 'flat' END AS roof FROM sized"
)
def imputed_heights(spark: SparkSession, d: str) -> DataFrame:
    """Heights and roofs of buildings that nobody measured."""
    b = _buildings(spark, d).withColumn("area", F.col("area") / 8)
    b = b.withColumn("height", estimated_height(F.col("kind"), F.col("area"), F.col("levels"), F.lit(0)))
    return b.select("id", F.round("height", 4).alias("height"), default_roof(F.col("kind"), F.col("area"), F.col("height")).alias("roof"))


@query(
    "SELECT id, round(CASE WHEN r >= 0.9 THEN ridge WHEN r >= 0.55 AND ridge < 40 THEN ridge ELSE mean END, 6) AS top, round(CASE WHEN r >= 0.9 THEN ridge WHEN r >= 0.55 AND ridge < 40 THEN least(greatest(2 * mean - ridge, 2), greatest(ridge - 1, 2)) ELSE mean END, 6) AS wall, r >= 0.55 AND r < 0.9 AND ridge < 40 AS pitched "
    "FROM (SELECT *, least(greatest(mean / greatest(ridge, 1e-6), 0), 1) AS r FROM (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS ridge, p_size * (p_partkey % 100) / 99.0::DOUBLE AS mean FROM part))"
)
def roofs_from_volume(spark: SparkSession, d: str) -> DataFrame:
    """Roof and wall tops from peak and mean heights."""
    shape = roof_shape(F.col("p_size").cast("double"), F.col("p_size") * (F.col("p_partkey") % 100) / 99.0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(shape["top"], 6).alias("top"), F.round(shape["wall"], 6).alias("wall"), shape["pitched"].alias("pitched"))


@query(
    f"WITH zones(k, least_storeys, zone) AS (VALUES {_steps(ZONES)}), lots AS (SELECT p_partkey AS id, p_partkey % 10 AS around, ['residential', 'mixed', 'commercial', 'office', 'industrial', ''][p_size % 6 + 1] AS plan FROM part) "
    "SELECT id, zone FROM lots JOIN zones ON k = plan AND least_storeys <= around QUALIFY row_number() OVER (PARTITION BY id ORDER BY least_storeys DESC) = 1"
)
def lot_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zones of lots by plan and storeys around."""
    plan = F.element_at(F.array(*map(F.lit, ("residential", "mixed", "commercial", "office", "industrial", "park"))), (F.col("p_size") % 6 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), planned_zone(plan, F.col("p_partkey") % 10).alias("zone"))


_TM = "SELECT id, lat * pi() / 180 AS phi, (lon - 16.5) * pi() / 180 * cos(lat * pi() / 180) AS a, 0.006694380022900788::DOUBLE AS e, 0.006739496775478857::DOUBLE AS ep FROM (SELECT id, 45.8 + z / 111320.0 AS lat, 16 + x / 77600.0 AS lon FROM v_point)"


PROJECTED = (
    f"SELECT id, 500000 + 0.9999 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a ** 5 / 120) AS east, 0.9999 * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a ** 6 / 720)) AS north "
    f"FROM (SELECT *, 6378137 / sqrt(1 - e * sin(phi) ** 2) AS n, tan(phi) ** 2 AS t, ep * cos(phi) ** 2 AS c, 6378137 * ((1 - e / 4 - 3 * e * e / 64 - 5 * e * e * e / 256) * phi - (3 * e / 8 + 3 * e * e / 32 + 45 * e * e * e / 1024) * sin(2 * phi) + (15 * e * e / 256 + 45 * e * e * e / 1024) * sin(4 * phi) - 35 * e * e * e / 3072 * sin(6 * phi)) AS m FROM ({_TM}))"
)


@query(f"SELECT id, round(east, 3) AS east, round(north, 3) AS north FROM ({PROJECTED})")
def projected_points(spark: SparkSession, d: str) -> DataFrame:
    """Degrees to easting and northing."""
    east, north = transverse_mercator(16 + F.col("x") / 77_600.0, 45.8 + F.col("z") / 111_320.0)
    return VIEWS["v_point"](spark, d).select("id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query(
    "SELECT vehicle, round(avg(CASE WHEN degrees(asin(sin(p) * sin(de) + cos(p) * cos(de) * cos(radians(15 * (18.697374558 + 24.06570982441908 * n) + 15.97) - ra))) > -0.833 THEN 1.0 ELSE 0.0 END), 6) AS daylight FROM "
    "(SELECT *, radians(45.81) AS p, asin(sin(t) * sin(l)) AS de, atan2(cos(t) * sin(l), cos(l)) AS ra FROM (SELECT *, radians(280.46 + 0.9856474 * n + 1.915 * sin(g) + 0.02 * sin(2 * g)) AS l, radians(23.439 - 0.0000004 * n) AS t FROM (SELECT *, radians(357.528 + 0.9856003 * n) AS g FROM (SELECT vehicle, epoch(ts) / 86400.0 + 2440587.5 - 2451545.0 AS n FROM v_pass)))) GROUP BY 1"
)
def daylight_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of each vehicle's passes by daylight: the sun's upper edge above the horizon."""
    up = sun_elevation(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 45.81, 15.97) > -0.833
    return VIEWS["v_pass"](spark, d).groupBy("vehicle").agg(F.round(F.avg(F.when(up, 1.0).otherwise(0.0)), 6).alias("daylight"))


_RING = [(-900.0, -900.0), (900.0, -700.0), (1100.0, 800.0), (0.0, 200.0), (-800.0, 1000.0)]
_SIDES = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS ax, {b}::DOUBLE AS az, {c}::DOUBLE AS bx, {e}::DOUBLE AS bz" for (a, b), (c, e) in zip(_RING, [*_RING[1:], _RING[0]], strict=True))


@query(
    "SELECT id, round(d, 4) AS edge, odd AND d > 100 AS within FROM (SELECT id, min(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(z - az - t * (bz - az), 2))) AS d, sum(CASE WHEN (az > z) <> (bz > z) AND x < (bx - ax) * (z - az) / nullif(bz - az, 0) + ax THEN 1 ELSE 0 END) % 2 = 1 AS odd "
    f"FROM (SELECT *, least(greatest(((x - ax) * (bx - ax) + (z - az) * (bz - az)) / (pow(bx - ax, 2) + pow(bz - az, 2)), 0), 1) AS t FROM v_point, ({_SIDES})) GROUP BY 1)"
)
def inset_area(spark: SparkSession, d: str) -> DataFrame:
    """Distance of points to an area's edge, and whether they lie in it by more than 100 m."""
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(z).alias("z")) for x, z in _RING])
    p = VIEWS["v_point"](spark, d).withColumn("edge", distance_to_edge(F.col("x"), F.col("z"), ring))
    return p.select("id", F.round("edge", 4).alias("edge"), (inside(F.col("x"), F.col("z"), ring) & (F.col("edge") > 100)).alias("within"))


@query(
    "SELECT o_zone, d_zone, trips FROM (SELECT o_zone, d_zone, trips, a.x AS ax, a.z AS az, b.x - a.x AS dx, b.z - a.z AS dz FROM v_od JOIN v_zone a ON a.zone = o_zone JOIN v_zone b ON b.zone = d_zone) "
    "WHERE sqrt(pow(2000 - ax - least(greatest(((2000 - ax) * dx + (1500 - az) * dz) / greatest(dx * dx + dz * dz, 1), 0), 1) * dx, 2) + pow(1500 - az - least(greatest(((2000 - ax) * dx + (1500 - az) * dz) / greatest(dx * dx + dz * dz, 1), 0), 1) * dz, 2)) < 600"
)
def trips_passing(spark: SparkSession, d: str) -> DataFrame:
    """Zone pairs whose straight line passes within 600 m of a place."""
    z = VIEWS["v_zone"](spark, d)
    od = VIEWS["v_od"](spark, d)
    for side, c in (("o_zone", "a"), ("d_zone", "b")):
        od = od.join(z.select(F.col("zone").alias(side), F.col("x").alias(f"{c}x"), F.col("z").alias(f"{c}z")), side)
    near = segment_distance(F.lit(2000.0), F.lit(1500.0), F.col("ax"), F.col("az"), F.col("bx"), F.col("bz")) < 600
    return od.where(near).select("o_zone", "d_zone", "trips")


@query(
    "SELECT a.id, coalesce(arg_min(b.id, row(round(sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)), 6), b.id)) FILTER (b.kind = 1 AND pow(a.x - b.x, 2) + pow(a.z - b.z, 2) <= 10000), arg_min(b.id, row(round(sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)), 6), b.id))) AS edge "
    "FROM v_point a LEFT JOIN v_point b ON b.kind IN (1, 2) AND pow(a.x - b.x, 2) + pow(a.z - b.z, 2) <= 160000 WHERE a.kind = 0 GROUP BY 1"
)
def attach_in_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The nearest local point within 100 m, else the nearest of all within 400 m."""
    p = VIEWS["v_point"](spark, d)
    local = stored(nearest(p.where("kind = 0").select("id", "x", "z"), p.where("kind = 1"), 100.0), "local")
    rest = nearest(local.where("nearest is null").select("id", "x", "z"), p.where("kind in (1, 2)"), 400.0)
    return local.where("nearest is not null").unionAll(rest).select("id", F.col("nearest").alias("edge"))


@query(
    "SELECT sum(CASE WHEN cost IS NOT NULL THEN trips ELSE 0 END) AS with_way, sum(CASE WHEN cost IS NULL THEN trips ELSE 0 END) AS without_way, round(sum(trips * cost) / greatest(sum(CASE WHEN cost IS NOT NULL THEN trips END), 1), 6) AS mean_cost, district FROM "
    "(SELECT o.*, a.district, cost FROM v_od o JOIN v_zone a ON a.zone = o_zone JOIN v_zone b ON b.zone = d_zone AND a.district = b.district LEFT JOIN v_arc ON src = o_zone AND dst = d_zone WHERE o_zone <> d_zone AND trips > 0) GROUP BY district"
)
def reach_within_districts(spark: SparkSession, d: str) -> DataFrame:
    """Trips inside each district with and without a direct way, and their weighted mean cost."""
    z, arcs = VIEWS["v_zone"](spark, d), VIEWS["v_arc"](spark, d).withColumnsRenamed({"src": "o_zone", "dst": "d_zone"})
    od = VIEWS["v_od"](spark, d).where("o_zone <> d_zone and trips > 0").join(z.select(F.col("zone").alias("o_zone"), "district"), "o_zone")
    od = od.join(z.select(F.col("zone").alias("d_zone"), F.col("district")), ["d_zone", "district"]).join(arcs, ["o_zone", "d_zone"], "left")
    known = F.sum(F.when(F.col("cost").isNotNull(), F.col("trips")).otherwise(0.0))
    return od.groupBy("district").agg(known.alias("with_way"), F.sum(F.when(F.col("cost").isNull(), F.col("trips")).otherwise(0.0)).alias("without_way"), F.round(F.sum(F.col("trips") * F.col("cost")) / F.greatest(known, F.lit(1.0)), 6).alias("mean_cost"))


@query("SELECT pass_id, round(kmh * CASE p WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.92 WHEN 3 THEN 0.87 WHEN 4 THEN 0.65 ELSE 0.9 END::DOUBLE, 6) AS kmh, CASE p WHEN 0 THEN 1.0 WHEN 1 THEN 1.1 WHEN 2 THEN 1.2 WHEN 3 THEN 1.15 WHEN 4 THEN 1.4 ELSE 1.15 END::DOUBLE AS headway, CASE p WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 WHEN 4 THEN 0.65 ELSE 1.0 END::DOUBLE AS accel FROM (SELECT *, pass_id % 6 AS p FROM v_pass)")
def weather_factors(spark: SparkSession, d: str) -> DataFrame:
    """Speed, headway and acceleration of passes under six kinds of weather, within their bounds."""
    clamp = lambda v, low, high: min(max(v, low), high)
    rows = [(i, clamp(s, 0.3, 1.2), clamp(h, 0.5, 3.0), clamp(a, 0.3, 1.5)) for i, (s, h, a) in enumerate(WEATHER.values())]
    presets = spark.createDataFrame(rows, "preset long, speed double, headway double, accel double")
    p = VIEWS["v_pass"](spark, d).withColumn("preset", F.col("pass_id") % len(WEATHER)).join(F.broadcast(presets), "preset")  # six rows
    return p.select("pass_id", F.round(F.col("kmh") * F.col("speed"), 6).alias("kmh"), "headway", "accel")


@query("SELECT route, count(*) AS visits, round(avg(late), 6) AS mean_late, CAST(max(late) AS BIGINT) AS most_late, round(avg(CASE WHEN late > 60 THEN 1.0 ELSE 0.0 END), 6) AS share_late FROM (SELECT route, (stop * 37 + trip * 11) % 300 - 60 AS late FROM v_stop_time) GROUP BY 1")
def lateness_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Actual less scheduled times of stop visits, by mode."""
    planned = VIEWS["v_stop_time"](spark, d)
    actual = planned.withColumn("actual", F.col("t_s") + (F.col("stop") * 37 + F.col("trip") * 11) % 300 - 60)
    late = actual.select("route", (F.col("actual") - F.col("t_s")).alias("late"))
    return late.groupBy("route").agg(F.count(F.lit(1)).alias("visits"), F.round(F.avg("late"), 6).alias("mean_late"), F.max("late").cast("long").alias("most_late"), F.round(F.avg(F.when(F.col("late") > 60, 1.0).otherwise(0.0)), 6).alias("share_late"))


@query("SELECT trip, count(*) AS n FROM (SELECT trip, stop FROM v_stop_time EXCEPT ALL SELECT trip, CASE WHEN trip % 7 = 0 AND seq = 1 THEN stop + 1 ELSE stop END FROM v_stop_time) GROUP BY 1")
def replay_differences(spark: SparkSession, d: str) -> DataFrame:
    """Recorded visits that a replay does not make, with their multiplicity."""
    s = VIEWS["v_stop_time"](spark, d)
    replay = s.select("trip", F.when((F.col("trip") % 7 == 0) & (F.col("seq") == 1), F.col("stop") + 1).otherwise(F.col("stop")).alias("stop"))
    return s.select("trip", "stop").exceptAll(replay).groupBy("trip").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT edge_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS vehicles FROM v_pass GROUP BY 1, 2")
def hour_arrays_to_rows(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of 24 counts an edge, as runs store them, back to rows of the hours with traffic."""
    hours = [F.count(F.when(F.hour("ts") == h, 1)).alias(f"h{h}") for h in range(24)]
    stored = VIEWS["v_pass"](spark, d).groupBy("edge_id").agg(*hours).select("edge_id", F.array(*[f"h{h}" for h in range(24)]).alias("counts"))
    return stored.select("edge_id", F.posexplode("counts").alias("hour", "vehicles")).where("vehicles > 0")


@query("SELECT edge_id, (mask & 4) <> 0 AS cars, (mask & 3) = 3 AS both, CAST(bit_count(mask) AS INTEGER) AS kinds, CASE WHEN (mask & 8) <> 0 THEN 'signals' WHEN edge_id % 4 = 0 THEN 'roundabout' ELSE 'priority' END AS control FROM (SELECT edge_id, bit_or(CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 WHEN 'error' THEN 8 ELSE 0 END)::INTEGER AS mask FROM v_pass GROUP BY 1)")
def mask_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests on bit sets, and junction control: signals before roundabout before priority."""
    bits = F.when(F.col("kind") == "view", 1).when(F.col("kind") == "click", 2).when(F.col("kind") == "purchase", 4).when(F.col("kind") == "error", 8).otherwise(0)
    m = VIEWS["v_pass"](spark, d).groupBy("edge_id").agg(F.bit_or(bits).alias("mask"))
    has = lambda b: F.col("mask").bitwiseAND(F.lit(b))
    control = F.when(has(8) != 0, "signals").when(F.col("edge_id") % 4 == 0, "roundabout").otherwise("priority")
    return m.select("edge_id", (has(4) != 0).alias("cars"), (has(3) == 3).alias("both"), F.bit_count("mask").alias("kinds"), control.alias("control"))


@query("SELECT trip, round(sum(d), 4) AS metres FROM (SELECT trip, sqrt(pow(x - lag(x) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM (SELECT trip, seq, (stop % 7) * 400.0 AS x, (stop // 7) * 300.0 AS z FROM v_stop_time) WINDOW w AS (PARTITION BY trip ORDER BY seq)) GROUP BY 1 HAVING count(d) > 0")
def trip_metres(spark: SparkSession, d: str) -> DataFrame:
    """Straight metres from stop to stop of each trip."""
    w = Window.partitionBy("trip").orderBy("seq")
    s = VIEWS["v_stop_time"](spark, d).select("trip", "seq", (F.col("stop") % 7 * 400.0).alias("x"), (F.floor(F.col("stop") / 7) * 300.0).alias("z"))
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("z") - F.lag("z").over(w), 2))
    return s.select("trip", step.alias("d")).groupBy("trip").agg(F.round(F.sum("d"), 4).alias("metres")).where("metres is not null")


@query("SELECT a.id, CAST(count(b.id) AS BIGINT) AS conflicts FROM (SELECT *, 1 << (id % 4) AS mask, floor(x / 300) AS cx, floor(z / 300) AS cz FROM v_point WHERE kind < 5) a JOIN (SELECT *, 1 << (id % 3) AS mask, floor(x / 300) AS cx, floor(z / 300) AS cz FROM v_point WHERE kind >= 5) b ON a.cx = b.cx AND a.cz = b.cz AND (a.mask & b.mask) <> 0 GROUP BY 1")
def mask_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two layers at one junction (cell) whose bit sets meet."""
    p = VIEWS["v_point"](spark, d).withColumns({"cx": cell(F.col("x"), 300.0), "cz": cell(F.col("z"), 300.0)})
    bit = lambda n: F.call_function("shiftleft", F.lit(1), (F.col("id") % n).cast("int"))
    a, b = p.where("kind < 5").select("id", "cx", "cz", bit(4).alias("m")), p.where("kind >= 5").select("cx", "cz", bit(3).alias("n"))
    return a.join(b, ["cx", "cz"]).where(F.col("m").bitwiseAND(F.col("n")) != 0).groupBy("id").agg(F.count(F.lit(1)).alias("conflicts"))


@query(
    "SELECT pass_id, CASE k WHEN 0 THEN 'car' WHEN 1 THEN 'lorry' WHEN 2 THEN 'bus' WHEN 3 THEN 'tram' WHEN 4 THEN 'train' WHEN 5 THEN 'bike' ELSE 'heavy lorry' END AS type, k IN (1, 6) AS is_lorry, "
    "round(least(kmh, 3.6 * CASE k WHEN 0 THEN 50.0 WHEN 1 THEN 25.0 WHEN 2 THEN 22.0 WHEN 3 THEN 19.5 WHEN 4 THEN 44.0 WHEN 5 THEN 5.0 ELSE 25.0 END::DOUBLE), 6) AS kmh, CASE k WHEN 1 THEN 7.5 WHEN 6 THEN 40.0 ELSE 0.0 END::DOUBLE AS tonnes FROM (SELECT *, pass_id % 7 AS k FROM v_pass)"
)
def vehicle_types(spark: SparkSession, d: str) -> DataFrame:
    """Passes with their vehicle type's name, weight and top speed."""
    types = spark.createDataFrame([(i, name, top, tonnes) for i, (name, _, top, tonnes) in enumerate(VEHICLES)], "k long, type string, top double, tonnes double")
    p = VIEWS["v_pass"](spark, d).withColumn("k", F.col("pass_id") % len(VEHICLES)).join(F.broadcast(types), "k")  # seven rows
    return p.select("pass_id", "type", F.col("type").isin("lorry", "heavy lorry").alias("is_lorry"), F.round(F.least(F.col("kmh"), 3.6 * F.col("top")), 6).alias("kmh"), "tonnes")


@query(
    "SELECT id, round(CASE k WHEN 0 THEN 2.9 * s WHEN 1 THEN 3.0 * s WHEN 2 THEN 4.5 + (s - 1) * 3.1 ELSE 4.5 * s END::DOUBLE, 6) AS eaves, round(CASE k WHEN 0 THEN 2.9 * s + 3 WHEN 1 THEN 3.0 * s + 2.5 WHEN 2 THEN 4.5 + (s - 1) * 3.1 ELSE 4.5 * s END::DOUBLE, 6) AS ridge, "
    "round(CASE k WHEN 2 THEN f * (s - 1) / 30 WHEN 3 THEN 0 ELSE f * s / 30 END::DOUBLE, 6) AS residents, round(CASE k WHEN 2 THEN f / 35 WHEN 3 THEN f * s / 35 ELSE 0 END::DOUBLE, 6) AS jobs, now >= done OR now < done - 100 AS finished "
    "FROM (SELECT p_partkey AS id, p_partkey % 4 AS k, p_size % 6 + 1 AS s, p_retailprice / 10 * 0.8 AS f, p_partkey % 300 AS done, 150 AS now FROM part)"
)
def building_occupants(spark: SparkSession, d: str) -> DataFrame:
    """Heights, residents and jobs of grown buildings by their archetype, and whether they are finished."""
    rows = [(i, *a) for i, a in enumerate(ARCHETYPES.values())]
    kinds = spark.createDataFrame(rows, "k long, storey double, ridge double, homes boolean, shops boolean, job_area double")
    key, n = F.col("p_partkey"), F.col("p_size") % 6 + 1
    b = table(spark, d, "part").select(key.alias("id"), (key % 4).alias("k"), n.alias("n"), (F.col("p_retailprice") / 10 * 0.8).alias("floor"), (key % 300).alias("done")).join(F.broadcast(kinds), "k")  # four rows
    eaves = F.when(F.col("shops"), 4.5 + (F.col("n") - 1) * F.col("storey")).when(~F.col("homes"), F.col("n") * 4.5).otherwise(F.col("n") * F.col("storey"))
    residents = F.when(F.col("homes"), F.col("floor") * (F.col("n") - F.col("shops").cast("int")) / 30).otherwise(0.0)
    jobs = F.when(F.col("shops"), F.col("floor") / F.col("job_area")).when(~F.col("homes"), F.col("floor") * F.col("n") / F.col("job_area")).otherwise(0.0)
    finished = (F.lit(150) >= F.col("done")) | (F.lit(150) < F.col("done") - 100)
    return b.select("id", F.round(eaves, 6).alias("eaves"), F.round(eaves + F.col("ridge"), 6).alias("ridge"), F.round(residents, 6).alias("residents"), F.round(jobs, 6).alias("jobs"), finished.alias("finished"))


@query("SELECT edge_id, count(*) FILTER (kind <> 'error') AS green_s, count(*) FILTER (kind = 'purchase') AS served, count(*) FILTER (kind = 'view') AS starved, count(*) FILTER (kind = 'click') AS blocked, round(3600.0 * count(*) FILTER (kind = 'purchase') / nullif(count(*) FILTER (kind <> 'error'), 0), 4) AS per_hour_of_green FROM v_pass GROUP BY 1")
def green_audit(spark: SparkSession, d: str) -> DataFrame:
    """What each approach did with its green: seconds, vehicles over the line, seconds without one or with one that stood."""
    count = lambda cond: F.count(F.when(cond, 1))
    kind = F.col("kind")
    g = VIEWS["v_pass"](spark, d).groupBy("edge_id").agg(count(kind != "error").alias("green_s"), count(kind == "purchase").alias("served"), count(kind == "view").alias("starved"), count(kind == "click").alias("blocked"))
    return g.withColumn("per_hour_of_green", F.round(3600.0 * F.col("served") / F.nullif(F.col("green_s"), F.lit(0)), 4))
