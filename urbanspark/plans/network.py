"""Routing arcs, reach, accessibility, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.functions.formulas import arc_cost
from urbanspark.operators.graph import inferred_lanes, relax, routing_arcs, worst_approach
from urbanspark.operators.spatial import clusters
from urbanspark.registry import query
from urbanspark.sources.tables import stored
from urbanspark.sources.views import VIEWS

_REACH = "WITH RECURSIVE walk(source, node, cost, hops) AS (SELECT DISTINCT src, src, CAST(0 AS DOUBLE), 0 FROM v_arc UNION SELECT w.source, a.dst, w.cost + a.cost, w.hops + 1 FROM walk w JOIN v_arc a ON a.src = w.node WHERE w.hops < 12 AND w.cost + a.cost <= 6000)"


def _arcs(spark: SparkSession, d: str) -> DataFrame:
    """Arcs between zones, written once for the starts and the search."""
    return stored(VIEWS["v_arc"](spark, d).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "cost"), "arcs")


def _reached(spark: SparkSession, d: str) -> DataFrame:
    arcs = _arcs(spark, d)
    return relax(arcs, arcs.select(F.col("src").alias("node")).distinct(), 6000.0)


@query(f"{_REACH} SELECT CAST(source AS BIGINT) AS source, CAST(node AS BIGINT) AS node, round(min(cost), 4) AS cost FROM walk GROUP BY ALL")
def reach_within_cost(spark: SparkSession, d: str) -> DataFrame:
    return _reached(spark, d).select("source", "node", F.round("cost", 4).alias("cost"))


@query(f"{_REACH} SELECT CAST(source AS BIGINT) AS source, CAST(node AS BIGINT) AS node, round(min(cost), 4) AS cost FROM walk GROUP BY ALL")
def reach_by_joins(spark: SparkSession, d: str) -> DataFrame:
    """The same by rounds of joins, for graphs too large to broadcast."""
    arcs = _arcs(spark, d)
    return relax(arcs, arcs.select(F.col("src").alias("node")).distinct(), 6000.0).select("source", "node", F.round("cost", 4).alias("cost"))


@query(f"{_REACH} SELECT CAST(source AS BIGINT) AS zone, round(sum(w * exp(-c / 3000)), 4) AS access FROM (SELECT source, node, min(cost) AS c FROM walk GROUP BY ALL) JOIN (SELECT zone, sum(places) AS w FROM v_service GROUP BY 1) ON zone = node GROUP BY 1")
def accessibility(spark: SparkSession, d: str) -> DataFrame:
    """Gravity accessibility of each zone to places."""
    w = VIEWS["v_service"](spark, d).groupBy(F.col("zone").cast("long").alias("node")).agg(F.sum("places").alias("w"))
    r = _reached(spark, d).join(w, "node")
    return r.groupBy(F.col("source").alias("zone")).agg(F.round(F.sum(F.col("w") * F.exp(-F.col("cost") / 3000)), 4).alias("access"))


@query(f"{_REACH} SELECT CAST(node AS BIGINT) AS zone, round(min(cost), 4) AS response FROM walk WHERE source % 5 = 0 GROUP BY 1")
def response_time_multi_source(spark: SparkSession, d: str) -> DataFrame:
    """Least cost from any of the stations (every fifth zone)."""
    arcs = _arcs(spark, d)
    stations = arcs.where("src % 5 = 0").select(F.col("src").alias("node")).distinct()
    return relax(arcs, stations, 6000.0).groupBy(F.col("node").alias("zone")).agg(F.round(F.min("cost"), 4).alias("response"))


_LINKS = "SELECT CAST(l_suppkey % 40 AS BIGINT) AS src, CAST(l_partkey % 40 AS BIGINT) AS dst, CAST(1 << (l_linenumber % 4) AS BIGINT) AS classes, l_quantity AS cost, CASE l_returnflag WHEN 'A' THEN 'left' WHEN 'N' THEN 'straight' ELSE 'back' END AS turn FROM lineitem"


@query(f"SELECT src, dst, CAST(bit_or(classes) AS BIGINT) AS classes, min(cost + CASE turn WHEN 'left' THEN 4 WHEN 'back' THEN 60 ELSE 0 END) AS cost FROM ({_LINKS}) l WHERE turn <> 'back' OR NOT EXISTS (SELECT 1 FROM ({_LINKS}) m WHERE m.src = l.src AND m.turn <> 'back') GROUP BY 1, 2")
def routing_graph(spark: SparkSession, d: str) -> DataFrame:
    """Arcs from links, with turn penalties and class masks."""
    from urbanspark.sources.views import table

    turn = F.when(F.col("l_returnflag") == "A", "left").when(F.col("l_returnflag") == "N", "straight").otherwise("back")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l_linenumber") % 4)
    links = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("src"), (F.col("l_partkey") % 40).alias("dst"), bit.alias("classes"), F.col("l_quantity").alias("cost"), turn.alias("turn"))
    return routing_arcs(links)


@query("WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM v_point a JOIN v_point b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.z - b.z, 2) <= 4900), walk(node, other) AS (SELECT a, a FROM e UNION SELECT w.node, e.b FROM walk w JOIN e ON e.a = w.other) SELECT node, min(other) AS component FROM walk GROUP BY 1")
def point_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Connected components of points at most 70 m apart."""
    return clusters(VIEWS["v_point"](spark, d), 70.0)


@query("SELECT edge_id, round(length / (limit_kmh / 3.6) + length * 0.038 + CASE WHEN limit_kmh >= 100 THEN 225.0 ELSE 0 END, 6) AS cost FROM v_edge")
def generalised_cost(spark: SparkSession, d: str) -> DataFrame:
    """Generalised seconds of each edge; motorways cost a euro."""
    e = VIEWS["v_edge"](spark, d)
    euros = F.when(F.col("limit_kmh") >= 100, 1.0).otherwise(0.0)
    return e.select("edge_id", F.round(arc_cost(F.col("length") / (F.col("limit_kmh") / 3.6), F.col("length"), euros), 6).alias("cost"))


@query("SELECT edge_id, CAST(min(CASE WHEN kind = 'error' THEN limit_kmh - 20 ELSE limit_kmh END) AS INTEGER) AS inferred FROM v_pass JOIN v_edge USING (edge_id) GROUP BY 1")
def inferred_limit(spark: SparkSession, d: str) -> DataFrame:
    """The lowest limit that an edge's passes suggest."""
    p = VIEWS["v_pass"](spark, d).join(VIEWS["v_edge"](spark, d), "edge_id")
    return p.groupBy("edge_id").agg(F.min(F.when(F.col("kind") == "error", F.col("limit_kmh") - 20).otherwise(F.col("limit_kmh"))).cast("int").alias("inferred"))


_WAYS = "w0 AS (SELECT p_partkey AS way, p_partkey % 97 AS a, p_partkey * 7 % 97 AS b, p_brand AS key, p_size % 2 = 0 AS oneway, CASE WHEN p_size % 3 = 0 THEN CAST(p_size % 5 + 1 AS INTEGER) END AS lanes, false AS found FROM part)"


def _lane_round(k: int) -> str:
    known = f"(SELECT way, unnest([a, b]) AS node, key, oneway, lanes FROM w{k})"
    return (
        f"w{k + 1} AS (SELECT w.way, a, b, w.key, w.oneway, coalesce(w.lanes, n) AS lanes, found OR n IS NOT NULL AS found FROM w{k} w LEFT JOIN "
        f"(SELECT x.way, min(y.lanes) AS n FROM {known} x JOIN {known} y ON x.node = y.node AND x.key = y.key AND x.oneway = y.oneway AND x.way <> y.way AND x.lanes IS NULL AND y.lanes IS NOT NULL GROUP BY 1) f ON f.way = w.way)"
    )


@query(f"WITH {_WAYS}, {', '.join(map(_lane_round, range(4)))} SELECT way, lanes FROM w4 WHERE found AND lanes >= CASE WHEN oneway THEN 2 ELSE 3 END")
def lanes_from_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Lanes of ways without a count from ways joined to their ends, spreading along chains."""
    from urbanspark.sources.views import table

    key = F.col("p_partkey")
    lanes = F.when(F.col("p_size") % 3 == 0, (F.col("p_size") % 5 + 1).cast("int"))
    ways = table(spark, d, "part").select(key.alias("way"), (key % 97).alias("a"), (key * 7 % 97).alias("b"), F.col("p_brand").alias("key"), (F.col("p_size") % 2 == 0).alias("oneway"), lanes.alias("lanes"))
    return inferred_lanes(ways)


@query(
    "WITH RECURSIVE e AS MATERIALIZED (SELECT edge_id AS edge, CAST(count(*) FILTER (kind = 'error') AS DOUBLE) AS loss, avg(kmh) / 400.0::DOUBLE AS share, any_value(length) AS length FROM v_pass JOIN v_edge USING (edge_id) GROUP BY 1), "
    "before AS (SELECT edge AS here, unnest([(edge * 3 + 1) % 100, (edge * 7 + 2) % 100]) AS prev FROM e), options AS MATERIALIZED (SELECT here, prev, loss AS more, length AS step FROM before JOIN e ON edge = prev WHERE share < 0.5), "
    "walk(start, here, lost, metres, seen) AS (SELECT edge, edge, loss, length, [edge] FROM e UNION ALL SELECT start, prev, lost + more, metres + step, list_append(seen, prev) FROM (SELECT w.*, o.prev, o.more, o.step FROM walk w JOIN options o ON o.here = w.here WHERE w.metres < 6000 AND NOT list_contains(w.seen, o.prev) "
    "QUALIFY row_number() OVER (PARTITION BY w.start ORDER BY o.more DESC, o.prev) = 1)) SELECT start, max(lost) AS lost FROM walk GROUP BY 1"
)
def worst_approaches(spark: SparkSession, d: str) -> DataFrame:
    """What is lost on the way upstream from each edge, always onto the slow edge that loses most."""
    p = VIEWS["v_pass"](spark, d).join(VIEWS["v_edge"](spark, d), "edge_id")
    edges = p.groupBy(F.col("edge_id").alias("edge")).agg(F.count_if(F.col("kind") == "error").cast("double").alias("loss"), (F.avg("kmh") / 400.0).alias("share"), F.any_value("length").alias("length"))
    before = edges.select("edge", F.explode(F.array((F.col("edge") * 3 + 1) % 100, (F.col("edge") * 7 + 2) % 100)).alias("prev"))
    return worst_approach(edges, before, edges.select("edge"), 6000.0, 0.5)
