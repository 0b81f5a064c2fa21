"""Traffic views of the relational tables: road edges, passes, zones, trips, points, stop times, arcs, runs.

Each view is a plan over the Parquet tables (VIEWS) and the same expression in SQL (SQL), for the oracles.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_edge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("edge_id"), F.col("p_brand").alias("road"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("length"), (20 + 2 * F.col("p_size")).cast("int").alias("limit_kmh"))


def v_pass(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("pass_id"), "ts", F.col("user_id").alias("vehicle"), F.col("event_type").alias("kind"), F.col("value").alias("kmh"), F.get_json_object("props", "$.k").cast("long").alias("edge_id")
    )


def v_zone(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    key = F.col("n_nationkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(key.cast("int").alias("zone"), F.col("r_name").alias("district"), (1000.0 * (key % 5)).alias("x"), (1000.0 * F.floor(key / 5)).cast("double").alias("z"))


def v_trip(spark: SparkSession, d: str) -> DataFrame:
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    customer, supplier = table(spark, d, "customer"), table(spark, d, "supplier")
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    return joined.select(F.col("c_nationkey").cast("int").alias("o_zone"), F.col("s_nationkey").cast("int").alias("d_zone"), F.col("o_orderdate").alias("depart"), F.col("l_quantity").cast("double").alias("weight"), F.col("l_extendedprice").cast("double").alias("euros"), F.col("l_returnflag").alias("kind"))


def v_od(spark: SparkSession, d: str) -> DataFrame:
    return v_trip(spark, d).groupBy("o_zone", "d_zone").agg(F.sum("weight").alias("trips"))


def v_point(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (5000.0 * F.col("embedding")[0].cast("double")).alias("x"), (5000.0 * F.col("embedding")[1].cast("double")).alias("z"), F.col("label").alias("kind"))


def v_stop(spark: SparkSession, d: str) -> DataFrame:
    return v_point(spark, d).where("id < 50").select(F.col("id").alias("stop"), (2000 + 2 * F.col("x")).alias("x"), (2000 + 2 * F.col("z")).alias("z"))


def v_shape(spark: SparkSession, d: str) -> DataFrame:
    """Edges between places: through the middle, bent to one side, to the next place but one."""
    p = v_point(spark, d)
    a, b = p.select("id", "kind", F.struct("x", "z").alias("a")), p.select((F.col("id") - 2).alias("id"), F.struct("x", "z").alias("b"))
    middle = F.struct((F.col("a.x") / 2 + F.col("b.x") / 2 + F.col("kind")).alias("x"), (F.col("a.z") / 2 + F.col("b.z") / 2 - F.col("kind")).alias("z"))
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    return a.join(b, "id").join(brand, "id", "left").select(F.col("id").alias("edge"), "name", F.array("a", middle, "b").alias("points"))


def v_home(spark: SparkSession, d: str) -> DataFrame:
    z = v_zone(spark, d)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("int").alias("zone"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("residents"))
    return c.join(F.broadcast(z), "zone").select("id", "zone", "x", "z", "residents")


def v_service(spark: SparkSession, d: str) -> DataFrame:
    z = v_zone(spark, d)
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("int").alias("zone"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("places"))
    return s.join(F.broadcast(z), "zone").select("id", "zone", "x", "z", "places")


def v_count(spark: SparkSession, d: str) -> DataFrame:
    total = lambda status: F.coalesce(F.sum(F.when(F.col("l_linestatus") == status, F.col("l_quantity"))), F.lit(0.0)).cast("double")
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("station")).agg(total("F").alias("counted"), total("O").alias("model"))


def v_stop_time(spark: SparkSession, d: str) -> DataFrame:
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    seq = line.select("l_orderkey", "l_partkey", F.row_number().over(order).alias("seq"))
    return seq.join(orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("trip"), "seq", (F.col("l_partkey") % 50).alias("stop"), F.col("o_orderpriority").alias("route"), ((F.col("o_orderkey") * 7919) % 86400 + 120 * F.col("seq")).cast("int").alias("t_s")
    )


def v_arc(spark: SparkSession, d: str) -> DataFrame:
    cost = v_trip(spark, d).where("o_zone <> d_zone").groupBy("o_zone", "d_zone").agg(F.min("euros").alias("cost"))
    rank = F.row_number().over(Window.partitionBy("o_zone").orderBy("cost", "d_zone"))
    return cost.withColumn("r", rank).where("r <= 3").select(F.col("o_zone").alias("src"), F.col("d_zone").alias("dst"), "cost")


def v_run(spark: SparkSession, d: str) -> DataFrame:
    minute = (F.unix_seconds(F.col("ts").cast("timestamp")) / 60).cast("long")
    return v_pass(spark, d).select(F.when(F.col("vehicle") % 2 == 0, "before").otherwise("after").alias("run"), "edge_id", minute.alias("minute"), "kmh")


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (v_edge, v_pass, v_zone, v_trip, v_od, v_point, v_stop, v_shape, v_home, v_service, v_count, v_stop_time, v_arc, v_run)}

SQL: dict[str, str] = {
    "v_edge": "SELECT p_partkey AS edge_id, p_brand AS road, p_type AS type, p_retailprice AS length, CAST(20 + 2 * p_size AS INTEGER) AS limit_kmh FROM part",
    "v_pass": "SELECT event_id AS pass_id, ts, user_id AS vehicle, event_type AS kind, value AS kmh, CAST(json_extract_string(props, '$.k') AS BIGINT) AS edge_id FROM events",
    "v_zone": "SELECT CAST(n_nationkey AS INTEGER) AS zone, r_name AS district, CAST(1000 * (n_nationkey % 5) AS DOUBLE) AS x, CAST(1000 * (n_nationkey // 5) AS DOUBLE) AS z FROM nation JOIN region ON n_regionkey = r_regionkey",
    "v_trip": "SELECT CAST(c_nationkey AS INTEGER) AS o_zone, CAST(s_nationkey AS INTEGER) AS d_zone, o_orderdate AS depart, CAST(l_quantity AS DOUBLE) AS weight, CAST(l_extendedprice AS DOUBLE) AS euros, l_returnflag AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey",
    "v_od": "SELECT o_zone, d_zone, sum(weight) AS trips FROM v_trip GROUP BY ALL",
    "v_point": "SELECT vec_id AS id, 5000.0::DOUBLE * embedding[1]::DOUBLE AS x, 5000.0::DOUBLE * embedding[2]::DOUBLE AS z, label AS kind FROM embeddings",
    "v_stop": "SELECT id AS stop, 2000 + 2 * x AS x, 2000 + 2 * z AS z FROM v_point WHERE id < 50",
    "v_shape": "SELECT a.id AS edge, p_brand AS name, [{'x': a.x, 'z': a.z}, {'x': a.x / 2 + b.x / 2 + a.kind, 'z': a.z / 2 + b.z / 2 - a.kind}, {'x': b.x, 'z': b.z}] AS points FROM v_point a JOIN v_point b ON b.id = a.id + 2 LEFT JOIN part ON p_partkey = a.id",
    "v_home": "SELECT c_custkey AS id, zone, x, z, greatest(c_acctbal, 0.0) AS residents FROM customer JOIN v_zone ON c_nationkey = zone",
    "v_service": "SELECT s_suppkey AS id, zone, x, z, greatest(s_acctbal, 0.0) AS places FROM supplier JOIN v_zone ON s_nationkey = zone",
    "v_count": "SELECT l_suppkey AS station, CAST(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS DOUBLE) AS counted, CAST(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS DOUBLE) AS model FROM lineitem GROUP BY 1",
    "v_stop_time": "SELECT l_orderkey AS trip, CAST(seq AS INTEGER) AS seq, l_partkey % 50 AS stop, o_orderpriority AS route, CAST((o_orderkey * 7919) % 86400 + 120 * seq AS INTEGER) AS t_s FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS seq FROM lineitem) JOIN orders ON l_orderkey = o_orderkey",
    "v_arc": "SELECT o_zone AS src, d_zone AS dst, cost FROM (SELECT o_zone, d_zone, min(euros) AS cost, row_number() OVER (PARTITION BY o_zone ORDER BY min(euros), d_zone) AS r FROM v_trip WHERE o_zone <> d_zone GROUP BY o_zone, d_zone) WHERE r <= 3",
    "v_run": "SELECT CASE WHEN vehicle % 2 = 0 THEN 'before' ELSE 'after' END AS run, edge_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute, kmh FROM v_pass",
}


def with_views(sql: str) -> str:
    """sql with the views it names, and those they name, as common table expressions."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", text):
            if name in SQL and name not in wanted:
                need(SQL[name])
                if name not in wanted:
                    wanted.append(name)

    need(sql)
    if not wanted:
        return sql
    views = ", ".join(f"{name} AS ({SQL[name]})" for name in wanted)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if own:
        return f"WITH {own[1] or ''}{views}, {sql[own.end() :]}"
    return f"WITH {views} {sql}"
