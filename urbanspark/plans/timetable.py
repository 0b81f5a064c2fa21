"""Timetables: patterns, thinning, filling, next departures, journeys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanspark.functions.formulas import expected_ride
from urbanspark.functions.text import clock
from urbanspark.operators.sequences import fill_gaps, thin
from urbanspark.registry import query
from urbanspark.sources.views import VIEWS, table


def _trips(spark: SparkSession, d: str) -> DataFrame:
    """trip, route, start second, stops in order."""
    s = VIEWS["v_stop_time"](spark, d).groupBy("trip", "route").agg(F.min("t_s").cast("long").alias("start"), F.sort_array(F.collect_list(F.struct("seq", "stop"))).alias("v"))
    return s.select("trip", "route", "start", F.transform("v", lambda x: x["stop"]).alias("stops"))


_TRIPS = "SELECT trip, route, CAST(min(t_s) AS BIGINT) AS start, list(stop ORDER BY seq) AS stops FROM v_stop_time GROUP BY 1, 2"


@query(
    f"SELECT route, headsign, pattern, n, round(share, 6) AS share FROM (SELECT *, n / sum(n) OVER (PARTITION BY route) AS share, row_number() OVER (PARTITION BY route ORDER BY n DESC, headsign, pattern) AS r "
    f"FROM (SELECT route, 'to ' || (stops[-1] // 40) AS headsign, array_to_string(list_transform(stops, lambda s: s // 40), '-') AS pattern, count(*) AS n FROM ({_TRIPS}) GROUP BY 1, 2, 3)) WHERE r <= 6 AND share >= 0.05"
)
def stop_patterns_topk(spark: SparkSession, d: str) -> DataFrame:
    """The six most frequent headsigns and whole stop sequences of each route with a twentieth of its trips (stops by district)."""
    district = lambda s: F.floor(s / 40)
    stops = F.transform("stops", district)
    headsign = F.concat(F.lit("to "), district(F.element_at("stops", -1)))
    p = _trips(spark, d).groupBy("route", headsign.alias("headsign"), F.array_join(stops, "-").alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("route")
    ranked = p.withColumns({"share": F.col("n") / F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "headsign", "pattern"))})
    return ranked.where("r <= 6 and share >= 0.05").select("route", "headsign", "pattern", "n", F.round("share", 6).alias("share"))


@query(f"SELECT trip FROM (SELECT trip, row_number() OVER (PARTITION BY route ORDER BY start, trip) - 1 AS k, count(*) OVER (PARTITION BY route) AS n FROM ({_TRIPS})) WHERE floor((k + 1) * floor(n * 0.6) / n) > floor(k * floor(n * 0.6) / n)")
def thin_service(spark: SparkSession, d: str) -> DataFrame:
    """Six tenths of each route's trips, evenly."""
    t = _trips(spark, d).select("trip", "route", "start")
    return thin(t, ["route"], ["start", "trip"], F.floor(F.col("_n") * 0.6), F.floor(F.col("start") / 60)).select("trip")


@query(f"SELECT trip, added, start FROM (SELECT trip, CAST(k AS INTEGER) AS added, CAST(start + CASE WHEN k > 0 THEN floor(gap * k / 3.0) ELSE 0 END AS BIGINT) AS start FROM (SELECT trip, start, lead(start) OVER (PARTITION BY route ORDER BY start, trip) - start AS gap FROM ({_TRIPS})), (SELECT unnest([0, 1, 2]) AS k) WHERE k = 0 OR gap BETWEEN 1 AND 7200)")
def densify_service(spark: SparkSession, d: str) -> DataFrame:
    """Two more departures in each gap of at most two hours."""
    t = _trips(spark, d).select("trip", "route", "start")
    return fill_gaps(t, ["route"], "start", 2, 7200, ["trip"], F.floor(F.col("start") / 60)).select("trip", "added", "start")


@query("SELECT stop, trip, wait FROM (SELECT stop, trip, CAST(((t_s - 82800) % 86400 + 86400) % 86400 AS BIGINT) AS wait, row_number() OVER (PARTITION BY stop ORDER BY ((t_s - 82800) % 86400 + 86400) % 86400, trip, seq) AS r FROM v_stop_time) WHERE r <= 3")
def next_departures_cyclic(spark: SparkSession, d: str) -> DataFrame:
    """The next three departures of each stop after 23:00, past midnight."""
    wait = F.pmod(F.col("t_s") - 82_800, F.lit(86_400)).cast("long")
    s = VIEWS["v_stop_time"](spark, d).withColumn("wait", wait)
    return s.withColumn("r", F.row_number().over(Window.partitionBy("stop").orderBy("wait", "trip", "seq"))).where("r <= 3").select("stop", "trip", "wait")


@query(f"SELECT r.route, h.h AS hour, count(t.trip) AS trips FROM (SELECT DISTINCT o_orderpriority AS route FROM orders) r CROSS JOIN (SELECT unnest(range(0, 24)) AS h) h LEFT JOIN ({_TRIPS}) t ON t.route = r.route AND (t.start // 3600) % 24 = h.h GROUP BY 1, 2")
def trips_by_hour_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    """Trips of each route and hour, all 24 hours."""
    n = _trips(spark, d).groupBy("route", (F.floor(F.col("start") / 3600) % 24).alias("hour")).agg(F.count(F.lit(1)).alias("trips"))
    spine = table(spark, d, "orders").select(F.col("o_orderpriority").alias("route")).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    return spine.join(n, ["route", "hour"], "left").na.fill(0, ["trips"])


@query("SELECT route, from_stop, to_stop, arcs, round(7200.0 / arcs, 6) AS headway, round(seconds, 6) AS seconds FROM (SELECT route, stop AS from_stop, nxt AS to_stop, count(*) AS arcs, avg(nt - t_s) AS seconds FROM (SELECT route, stop, t_s, lead(stop) OVER w AS nxt, lead(t_s) OVER w AS nt FROM v_stop_time WINDOW w AS (PARTITION BY trip ORDER BY seq)) WHERE nxt IS NOT NULL AND nxt <> stop GROUP BY 1, 2, 3)")
def journey_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Ride arcs of the timetable graph with headway and time."""
    return ride_arcs(spark, d).select("route", "from_stop", "to_stop", "arcs", F.round("headway", 6).alias("headway"), F.round("seconds", 6).alias("seconds"))


def ride_arcs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("trip").orderBy("seq")
    s = VIEWS["v_stop_time"](spark, d).select("route", "stop", "t_s", F.lead("stop").over(w).alias("to"), F.lead("t_s").over(w).alias("t2")).where("to is not null and to <> stop")
    arcs = s.groupBy("route", F.col("stop").alias("from_stop"), F.col("to").alias("to_stop")).agg(F.count(F.lit(1)).alias("arcs"), F.avg(F.col("t2") - F.col("t_s")).alias("seconds"))
    return arcs.withColumn("headway", 7200.0 / F.col("arcs"))


_ARCS = "SELECT route, stop AS from_stop, nxt AS to_stop, count(*) / 7200.0::DOUBLE AS f, avg(nt - t_s) AS seconds FROM (SELECT route, stop, t_s, lead(stop) OVER w AS nxt, lead(t_s) OVER w AS nt FROM v_stop_time WINDOW w AS (PARTITION BY trip ORDER BY seq)) WHERE nxt IS NOT NULL AND nxt <> stop GROUP BY 1, 2, 3"
_EXPECT = "(2 * least(0.5 / ({f}), 900) + 180 + ({r}) / ({f}))"


@query(
    f"WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY from_stop, to_stop ORDER BY round(seconds, 6), route) AS k FROM ({_ARCS})), "
    f"b AS (SELECT from_stop, to_stop, k, f, f * seconds AS r FROM l WHERE k = 1 UNION ALL SELECT l.from_stop, l.to_stop, l.k, b.f + l.f, b.r + l.f * l.seconds FROM b JOIN l ON l.from_stop = b.from_stop AND l.to_stop = b.to_stop AND l.k = b.k + 1 "
    f"WHERE {_EXPECT.format(f='b.f + l.f', r='b.r + l.f * l.seconds')} < {_EXPECT.format(f='b.f', r='b.r')}) "
    f"SELECT from_stop, to_stop, round(arg_max({_EXPECT.format(f='f', r='r')}, k), 4) AS expected, CAST(max(k) AS INTEGER) AS lines FROM b GROUP BY 1, 2 HAVING max(k) > 1"
)
def common_line_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Generalised time between stop pairs over the bundle of two or more lines worth boarding.

    The quickest lines join, one a route, while each lowers the expected time; the first that does not ends the bundle.
    """
    line = F.struct(F.round("seconds", 6).alias("order"), "route", "seconds", (1 / F.col("headway")).alias("f"))
    arcs = ride_arcs(spark, d).groupBy("from_stop", "to_stop").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    start = F.struct(F.lit(0.0).alias("f"), F.lit(0.0).alias("r"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def board(acc, x):
        f, r = acc["f"] + x["f"], acc["r"] + x["f"] * x["seconds"]
        worth = (acc["n"] == 0) | (expected_ride(f, r) < expected_ride(F.nullif(acc["f"], F.lit(0.0)), acc["r"]))
        taken = F.struct(f.alias("f"), r.alias("r"), (acc["n"] + 1).alias("n"), F.lit(False).alias("over"))
        left = F.struct(acc["f"].alias("f"), acc["r"].alias("r"), acc["n"].alias("n"), F.lit(True).alias("over"))
        return F.when(~acc["over"] & worth, taken).otherwise(left)

    out = arcs.where("size(lines) > 1").withColumn("b", F.aggregate("lines", start, board)).where("b.n > 1")
    return out.select("from_stop", "to_stop", F.round(expected_ride(F.col("b.f"), F.col("b.r")), 4).alias("expected"), F.col("b.n").alias("lines"))


@query("SELECT o_orderkey AS trip, k, printf('%02d:%02d', CAST(((base + k * 900) // 3600) AS INTEGER), CAST(((base + k * 900) // 60) % 60 AS INTEGER)) AS departs FROM (SELECT o_orderkey, (o_orderkey * 7919) % 86400 AS base FROM orders), (SELECT unnest(range(0, 4)) AS k)")
def new_line_departures(spark: SparkSession, d: str) -> DataFrame:
    """Four departures a quarter of an hour apart for every order's line."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("trip"), ((F.col("o_orderkey") * 7919) % 86400).alias("base"))
    k = o.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return k.select("trip", "k", clock(F.col("base") + F.col("k") * 900).alias("departs"))


@query("SELECT d AS day, count(*) AS services FROM (SELECT o_custkey % 50 AS s, CAST(o_orderdate AS DATE) AS d FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5 AND o_orderstatus = 'O' UNION SELECT o_custkey % 50, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey % 50, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def exceptions_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Services running each day: weekday flags, with added and without removed exceptions."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("s"), F.to_date("o_orderdate").alias("day"), "o_orderstatus", F.dayofweek("o_orderdate").alias("w"))
    part = lambda cond: o.where(cond).select("s", "day")
    runs = part("w between 2 and 6 and o_orderstatus = 'O'").union(part("o_orderstatus = 'P'")).distinct().join(part("o_orderstatus = 'F'").distinct(), ["s", "day"], "left_anti")
    return runs.groupBy("day").agg(F.count(F.lit(1)).alias("services"))


@query("SELECT route, count(DISTINCT trip) AS trips, CAST(sum(dt) AS BIGINT) AS seconds, round(sum(dt) * 8.0 / 3600, 6) AS vehicle_km FROM (SELECT route, trip, max(t_s) - min(t_s) AS dt FROM v_stop_time GROUP BY 1, 2) GROUP BY 1")
def route_production(spark: SparkSession, d: str) -> DataFrame:
    """Trips, running time and kilometres of each route."""
    t = VIEWS["v_stop_time"](spark, d).groupBy("route", "trip").agg((F.max("t_s") - F.min("t_s")).cast("long").alias("dt"))
    return t.groupBy("route").agg(F.count(F.lit(1)).alias("trips"), F.sum("dt").alias("seconds"), F.round(F.sum("dt") * 8.0 / 3600, 6).alias("vehicle_km"))


