"""Public transport: the timetable as a graph, journey times between zones, boardings along the best ways, routes by car."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.functions.formulas import logit_share
from urbanspark.operators.graph import fastest_paths
from urbanspark.operators.journeys import boardings, journeys, search
from urbanspark.operators.spatial import within
from urbanspark.plans.timetable import ride_arcs
from urbanspark.registry import query
from urbanspark.sources.tables import stored
from urbanspark.sources.views import VIEWS

# Fixed values of walking, waiting and driving (seconds, metres, metres a second).
WALK_SPEED, WALK_DETOUR, WALK_WEIGHT = 1.25, 1.3, 2.0
ACCESS, TRANSFER = 1_000.0, 250.0
WAIT_WEIGHT, WAIT_CAP, BOARDING, LEAST_RIDE, PEAK_S = 2.0, 900.0, 180.0, 30.0, 7_200.0
CAR_DETOUR, CAR_SPEED, CAR_EXTRA = 1.3, 30 / 3.6, 480.0

_NEXT = "SELECT route, stop, t_s, lead(stop) OVER w AS nxt, lead(t_s) OVER w AS nt FROM v_stop_time WINDOW w AS (PARTITION BY trip ORDER BY seq)"
_RIDES = f"SELECT route, stop AS a, nxt AS b, count(*) AS n, avg(nt - t_s) AS seconds FROM ({_NEXT}) WHERE nxt IS NOT NULL AND nxt <> stop GROUP BY 1, 2, 3"
_WALK = f"round(sqrt(pow(p.x - q.x, 2) + pow(p.z - q.z, 2)) * {WALK_DETOUR}::DOUBLE / {WALK_SPEED}::DOUBLE, 4)"
_GRAPH = (
    f"SELECT 'ride' AS kind, route, route || ':' || a AS src, route || ':' || b AS dst, round(greatest(seconds, {LEAST_RIDE}), 4) AS plain, round(greatest(seconds, {LEAST_RIDE}), 4) AS cost FROM rides "
    f"UNION ALL SELECT 'board', route, 's:' || a, route || ':' || a, round(least({PEAK_S / 2}::DOUBLE / sum(n), {WAIT_CAP}), 4), round({WAIT_WEIGHT} * least({PEAK_S / 2}::DOUBLE / sum(n), {WAIT_CAP}) + {BOARDING}, 4) FROM rides GROUP BY route, a "
    "UNION ALL SELECT DISTINCT 'alight', route, route || ':' || b, 's:' || b, 0.0::DOUBLE, 0.0::DOUBLE FROM rides "
    f"UNION ALL SELECT 'transfer', NULL, 's:' || p.stop, 's:' || q.stop, {_WALK}, {WALK_WEIGHT}::DOUBLE * {_WALK} FROM v_stop p JOIN v_stop q ON p.stop <> q.stop AND pow(p.x - q.x, 2) + pow(p.z - q.z, 2) <= {TRANSFER**2}"
)


def _walk(dist: Column) -> Column:
    return F.round(dist * WALK_DETOUR / WALK_SPEED, 4)


def _stops(spark: SparkSession, d: str) -> DataFrame:
    return VIEWS["v_stop"](spark, d).select(F.col("stop").alias("id"), "x", "z")


def timetable_graph(spark: SparkSession, d: str) -> DataFrame:
    """kind, route, src, dst, plain, cost: rides between a line's calls, boarding (half the headway, weighed double, and the
    boarding itself), alighting, walks between stops near each other."""
    rides = stored(ride_arcs(spark, d), "rides")
    at = lambda stop: F.concat(F.col("route"), F.lit(":"), F.col(stop).cast("string"))
    place = lambda stop: F.concat(F.lit("s:"), F.col(stop).cast("string"))
    arc = lambda df, kind, route, a, b, plain, cost: df.select(F.lit(kind).alias("kind"), route.alias("route"), a.alias("src"), b.alias("dst"), F.round(plain, 4).alias("plain"), F.round(cost, 4).alias("cost"))
    route, zero = F.col("route"), F.lit(0.0)
    ride = F.greatest(F.col("seconds"), F.lit(LEAST_RIDE))
    wait = F.least(PEAK_S / 2 / F.col("n"), F.lit(WAIT_CAP))
    stops = _stops(spark, d)
    walks = within(stops, stops, TRANSFER).where("l_id <> r_id")
    parts = (
        arc(rides, "ride", route, at("from_stop"), at("to_stop"), ride, ride),
        arc(rides.groupBy("route", "from_stop").agg(F.sum("arcs").alias("n")), "board", route, place("from_stop"), at("from_stop"), wait, WAIT_WEIGHT * wait + BOARDING),
        arc(rides.select("route", "to_stop").distinct(), "alight", route, at("to_stop"), place("to_stop"), zero, zero),
        arc(walks, "transfer", F.lit(None).cast("string"), place("l_id"), place("r_id"), _walk(F.col("dist")), WALK_WEIGHT * _walk(F.col("dist"))),
    )
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query(f"WITH rides AS ({_RIDES}) {_GRAPH}")
def journey_graph(spark: SparkSession, d: str) -> DataFrame:
    """The timetable as a graph."""
    return timetable_graph(spark, d)


_SEARCH = (
    f"WITH RECURSIVE rides AS ({_RIDES}), graph AS MATERIALIZED ({_GRAPH}), "
    f"legs AS (SELECT zone AS place, 's:' || q.stop AS node, {_WALK} AS plain, {WALK_WEIGHT}::DOUBLE * {_WALK} AS cost FROM v_zone p JOIN v_stop q ON pow(p.x - q.x, 2) + pow(p.z - q.z, 2) <= {ACCESS**2}), "
    "best(source, node, cost, plain, prev) USING KEY (source, node) AS (SELECT place, node, cost, plain, CAST(NULL AS VARCHAR) FROM legs UNION "
    "SELECT c.source, c.node, c.cost, c.plain, c.prev FROM (SELECT b.source, a.dst AS node, b.cost + a.cost AS cost, b.plain + a.plain AS plain, b.node AS prev FROM best b JOIN graph a ON a.src = b.node "
    "QUALIFY row_number() OVER (PARTITION BY b.source, a.dst ORDER BY b.cost + a.cost, b.plain + a.plain, b.node) = 1) c "
    "LEFT JOIN recurring.best r ON r.source = c.source AND r.node = c.node WHERE r.cost IS NULL OR c.cost < r.cost OR (c.cost = r.cost AND c.plain < r.plain)), "
    "ways AS (SELECT b.source, l.place, b.cost + l.cost AS cost, b.plain + l.plain AS plain, b.node FROM best b JOIN legs l ON l.node = b.node AND l.place <> b.source "
    "QUALIFY row_number() OVER (PARTITION BY b.source, l.place ORDER BY b.cost + l.cost, b.plain + l.plain, b.node) = 1)"
)


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph, the walks between zones and stops, the labels from all zones."""
    graph = stored(timetable_graph(spark, d), "graph")
    zones = VIEWS["v_zone"](spark, d).select(F.col("zone").alias("id"), "x", "z")
    walk = _walk(F.col("dist"))
    legs = within(zones, _stops(spark, d), ACCESS).select(F.col("l_id").alias("place"), F.concat(F.lit("s:"), F.col("r_id").cast("string")).alias("node"), walk.alias("plain"), (WALK_WEIGHT * walk).alias("cost"))
    return graph, legs, search(graph, legs.withColumnRenamed("place", "source"))


@query(f"{_SEARCH} SELECT source AS o_zone, place AS d_zone, round(cost, 4) AS generalised, round(plain, 4) AS seconds FROM ways UNION ALL SELECT zone, zone, 0.0, 0.0 FROM v_zone")
def journey_times(spark: SparkSession, d: str) -> DataFrame:
    """Journey times between all zones by public transport: generalised, and as they pass on the generalised best way."""
    _, legs, labels = _labels(spark, d)
    here = VIEWS["v_zone"](spark, d).select("zone", F.col("zone").alias("to"), F.lit(0.0).alias("generalised"), F.lit(0.0).alias("seconds"))
    ways = journeys(labels, legs).select(F.col("source").alias("o_zone"), F.col("place").alias("d_zone"), F.round("cost", 4).alias("generalised"), F.round("plain", 4).alias("seconds"))
    return ways.unionAll(here)


_CAR = f"(sqrt(pow(p.x - q.x, 2) + pow(p.z - q.z, 2)) * {CAR_DETOUR}::DOUBLE / {CAR_SPEED!r}::DOUBLE + {CAR_EXTRA})"
_FLOW = f"SELECT w.source, w.node, sum(trips / greatest(1 - s, 0.001) * s) AS flow FROM (SELECT w.*, o.trips, 1 / (1 + exp(-(1.68 - 0.04 * (w.cost - {_CAR}) / 60))) AS s FROM ways w JOIN v_od o ON o.o_zone = w.source AND o.d_zone = w.place JOIN v_zone p ON p.zone = w.source JOIN v_zone q ON q.zone = w.place) w GROUP BY 1, 2"


@query(
    f"{_SEARCH}, walk AS (SELECT * FROM ({_FLOW}) UNION ALL SELECT w.source, b.prev, w.flow FROM walk w JOIN best b ON b.source = w.source AND b.node = w.node WHERE b.prev IS NOT NULL) "
    "SELECT g.route, round(sum(w.flow), 4) AS boardings FROM walk w JOIN best b ON b.source = w.source AND b.node = w.node JOIN graph g ON g.kind = 'board' AND g.src = b.prev AND g.dst = w.node GROUP BY 1"
)
def boardings_by_route(spark: SparkSession, d: str) -> DataFrame:
    """Boardings of each route: the trips between zones by public transport's share, led along their best ways."""
    graph, legs, labels = _labels(spark, d)
    z = VIEWS["v_zone"](spark, d)
    ways = journeys(labels, legs).join(z.select(F.col("zone").alias("source"), F.col("x").alias("px"), F.col("z").alias("pz")), "source").join(z.select(F.col("zone").alias("place"), "x", "z"), "place")
    car = F.hypot(F.col("x") - F.col("px"), F.col("z") - F.col("pz")) * CAR_DETOUR / CAR_SPEED + CAR_EXTRA
    od = VIEWS["v_od"](spark, d).select(F.col("o_zone").alias("source"), F.col("d_zone").alias("place"), "trips")
    share = ways.withColumn("s", logit_share(car, F.col("cost"))).join(od, ["source", "place"])
    flows = share.select("source", "node", (F.col("trips") / F.greatest(1 - F.col("s"), F.lit(0.001)) * F.col("s")).alias("flow"))
    lines = graph.where("kind = 'board'").select("src", "dst", F.col("route").alias("line"), F.lit(1.0).alias("share"))
    return boardings(labels, flows, lines).select(F.col("line").alias("route"), F.round("boardings", 4).alias("boardings"))


@query(
    "WITH RECURSIVE best(source, node, cost, prev) USING KEY (source, node) AS (SELECT zone, zone, 0.0::DOUBLE, CAST(NULL AS INTEGER) FROM v_zone UNION "
    "SELECT c.source, c.node, c.cost, c.prev FROM (SELECT b.source, a.dst AS node, b.cost + a.cost AS cost, b.node AS prev FROM best b JOIN v_arc a ON a.src = b.node QUALIFY row_number() OVER (PARTITION BY b.source, a.dst ORDER BY b.cost + a.cost, b.node) = 1) c "
    "LEFT JOIN recurring.best r ON r.source = c.source AND r.node = c.node WHERE r.cost IS NULL OR c.cost < r.cost), "
    "back(source, target, node, path) AS (SELECT source, node, node, CAST(node AS VARCHAR) FROM best UNION ALL SELECT k.source, k.target, b.prev, b.prev || '>' || k.path FROM back k JOIN best b ON b.source = k.source AND b.node = k.node WHERE b.prev IS NOT NULL) "
    "SELECT CAST(z.zone AS BIGINT) AS source, CAST((z.zone * 7 + 3) % 25 AS BIGINT) AS target, round(b.cost, 4) AS cost, k.path FROM v_zone z LEFT JOIN best b ON b.source = z.zone AND b.node = (z.zone * 7 + 3) % 25 "
    "LEFT JOIN back k ON k.source = z.zone AND k.target = b.node AND k.node = k.source"
)
def fastest_routes(spark: SparkSession, d: str) -> DataFrame:
    """The fastest route between some pairs of zones."""
    arcs = VIEWS["v_arc"](spark, d).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "cost")
    pairs = VIEWS["v_zone"](spark, d).select(F.col("zone").cast("long").alias("source"), ((F.col("zone") * 7 + 3) % 25).cast("long").alias("target"))
    out = fastest_paths(arcs, pairs)
    return out.select("source", "target", F.round("cost", 4).alias("cost"), F.array_join("path", ">").alias("path"))
