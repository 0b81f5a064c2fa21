"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanspark.functions.formulas import overlap_seconds
from urbanspark.functions.text import fold
from urbanspark.operators.aggregates import apportion, group_shares, majority
from urbanspark.registry import query
from urbanspark.sources.views import VIEWS, table


@query("SELECT e.road, e.type, count(*) AS n, round(avg(p.kmh), 6) AS kmh FROM v_pass p JOIN v_edge e USING (edge_id) GROUP BY 1, 2")
def gather_edges(spark: SparkSession, d: str) -> DataFrame:
    """Passes with their edge's road and type."""
    return VIEWS["v_pass"](spark, d).join(VIEWS["v_edge"](spark, d), "edge_id").groupBy("road", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("kmh"), 6).alias("kmh"))


@query("SELECT c_custkey AS id, lower(c_mktsegment) AS segment, CAST(CASE lower(c_mktsegment) WHEN 'automobile' THEN 1 WHEN 'building' THEN 2 WHEN 'furniture' THEN 3 WHEN 'household' THEN 4 WHEN 'machinery' THEN 5 END AS INTEGER) AS code FROM customer")
def total_name_join(spark: SparkSession, d: str) -> DataFrame:
    """A join by folded name that must find every row: a miss is an error."""
    names = spark.createDataFrame([("Automobile", 1), ("Building", 2), ("Furniture", 3), ("Household", 4), ("Machinery", 5)], "name string, code int").select(fold(F.col("name")).alias("segment"), "code")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), fold(F.col("c_mktsegment")).alias("segment"))
    joined = c.join(F.broadcast(names), "segment", "left")  # five rows
    return joined.select("id", "segment", F.when(F.col("code").isNull(), F.raise_error(F.concat(F.lit("no code for "), F.col("segment")))).otherwise(F.col("code")).cast("int").alias("code"))


@query("WITH one AS (SELECT s_nationkey AS k, min(s_suppkey) AS s FROM supplier GROUP BY 1 HAVING count(*) = 1), local AS (SELECT s_nationkey AS k, min(s_suppkey) AS s FROM supplier WHERE s_acctbal > 8000 GROUP BY 1), region_best AS (SELECT n_regionkey AS r, min(s_suppkey) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT c_custkey AS id, coalesce(l.s, o.s, r.s) AS supplier, CAST(CASE WHEN l.s IS NOT NULL THEN 1 WHEN o.s IS NOT NULL THEN 2 WHEN r.s IS NOT NULL THEN 3 END AS INTEGER) AS tier FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN local l ON l.k = c_nationkey LEFT JOIN one o ON o.k = c_nationkey LEFT JOIN region_best r ON r.r = n_regionkey")
def tiered_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The strong local supplier, else the only local one, else the region's first."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    local = s.where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s1"))
    one = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_suppkey").alias("s2"), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    region = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.min("s_suppkey").alias("s3"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    j = c.join(local, "c_nationkey", "left").join(one, "c_nationkey", "left").join(region, "n_regionkey", "left")
    tier = F.when(F.col("s1").isNotNull(), 1).when(F.col("s2").isNotNull(), 2).when(F.col("s3").isNotNull(), 3)
    return j.select(F.col("c_custkey").alias("id"), F.coalesce("s1", "s2", "s3").alias("supplier"), tier.alias("tier"))


@query("SELECT vehicle, pass_id FROM v_pass p WHERE kind = 'purchase' AND EXISTS (SELECT 1 FROM v_pass q WHERE q.vehicle = p.vehicle AND q.kind = 'error') AND NOT EXISTS (SELECT 1 FROM v_edge e WHERE e.edge_id = p.edge_id AND e.limit_kmh >= 100)")
def semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    """Purchases of vehicles with an error, but not on motorways."""
    p = VIEWS["v_pass"](spark, d)
    failed = p.where("kind = 'error'").select("vehicle").distinct()
    fast = VIEWS["v_edge"](spark, d).where("limit_kmh >= 100").select("edge_id")
    return p.where("kind = 'purchase'").join(failed, "vehicle", "left_semi").join(fast, "edge_id", "left_anti").select("vehicle", "pass_id")


@query("SELECT a.zone AS o_zone, b.zone AS d_zone, round(sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)), 6) AS metres FROM v_zone a JOIN v_zone b ON a.zone <> b.zone")
def zone_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All ordered pairs of zones (a table of fixed, small size) with their distance."""
    a, b = VIEWS["v_zone"](spark, d), VIEWS["v_zone"](spark, d)
    a, b = a.select(F.col("zone").alias("o_zone"), F.col("x").alias("ax"), F.col("z").alias("az")), b.select(F.col("zone").alias("d_zone"), "x", "z")
    return a.crossJoin(b).where("o_zone <> d_zone").select("o_zone", "d_zone", F.round(F.hypot(F.col("ax") - F.col("x"), F.col("az") - F.col("z")), 6).alias("metres"))


@query("SELECT p.pass_id, q.kmh AS last_kmh FROM v_pass p ASOF LEFT JOIN (SELECT vehicle, ts, kmh FROM v_pass WHERE kind = 'view') q ON p.vehicle = q.vehicle AND p.ts > q.ts WHERE p.kind = 'click'")
def as_of_speed(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the vehicle's last view before it: one window over both, no theta join."""
    p = VIEWS["v_pass"](spark, d).where("kind in ('click', 'view')")
    before = Window.partitionBy("vehicle").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seen = F.last(F.when(F.col("kind") == "view", F.col("kmh")), ignorenulls=True).over(before)
    return p.withColumn("ts", micros).withColumn("last_kmh", seen).where("kind = 'click'").select("pass_id", "last_kmh")


@query("SELECT trip, h AS hour, least(t1, (h + 1) * 3600) - greatest(t0, h * 3600) AS seconds FROM (SELECT trip, CAST(min(t_s) AS BIGINT) AS t0, CAST(max(t_s) AS BIGINT) AS t1 FROM v_stop_time GROUP BY 1), (SELECT unnest(range(0, 26)) AS h) WHERE least(t1, (h + 1) * 3600) > greatest(t0, h * 3600)")
def interval_hours(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of each trip in each hour it touches."""
    t = VIEWS["v_stop_time"](spark, d).groupBy("trip").agg(F.min("t_s").cast("long").alias("t0"), F.max("t_s").cast("long").alias("t1"))
    h = t.withColumn("hour", F.explode(F.sequence(F.floor(F.col("t0") / 3600), F.floor(F.col("t1") / 3600))))
    return h.withColumn("seconds", overlap_seconds(F.col("t0"), F.col("t1"), F.col("hour") * 3600, (F.col("hour") + 1) * 3600)).where("seconds > 0").select("trip", "hour", "seconds")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal >= 7500 THEN 'gold' WHEN c_acctbal >= 2500 THEN 'silver' WHEN c_acctbal >= 0 THEN 'bronze' END AS fee FROM customer")
def threshold_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The fee class with the highest threshold not above the balance, from a table of thresholds."""
    steps = sorted([(0.0, "bronze"), (2500.0, "silver"), (7500.0, "gold")], reverse=True)
    fee = F.coalesce(*[F.when(F.col("c_acctbal") >= low, name) for low, name in steps])
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), fee.alias("fee"))


@query("SELECT a.stop AS from_stop, b.stop AS to_stop, count(*) AS trips, CAST(min(b.t_s - a.t_s) AS BIGINT) AS fastest, count(DISTINCT a.route) AS routes FROM v_stop_time a JOIN v_stop_time b ON a.trip = b.trip AND a.seq < b.seq GROUP BY 1, 2")
def common_lines(spark: SparkSession, d: str) -> DataFrame:
    """All ordered stop pairs of each trip, across routes."""
    s = VIEWS["v_stop_time"](spark, d)
    a, b = s.select("trip", "route", F.col("stop").alias("from_stop"), F.col("seq").alias("s1"), F.col("t_s").alias("t1")), s.select("trip", F.col("stop").alias("to_stop"), F.col("seq").alias("s2"), F.col("t_s").alias("t2"))
    pairs = a.join(b, "trip").where("s1 < s2")
    return pairs.groupBy("from_stop", "to_stop").agg(F.count(F.lit(1)).alias("trips"), F.min(F.col("t2") - F.col("t1")).cast("long").alias("fastest"), F.countDistinct("route").alias("routes"))


@query("SELECT o_zone, d_zone, round(trips, 6) AS trips, round(trips / sum(trips) OVER (PARTITION BY o_zone), 6) AS share FROM v_od")
def od_matrix_row_shares(spark: SparkSession, d: str) -> DataFrame:
    od = group_shares(VIEWS["v_od"](spark, d), ["o_zone"], "trips")
    return od.select("o_zone", "d_zone", F.round("trips", 6).alias("trips"), F.round("share", 6).alias("share"))


@query("SELECT h.id, round(CASE WHEN t.a > 0 THEN h.residents * s.total / t.a ELSE 0 END, 4) AS value FROM v_home h JOIN (SELECT zone, sum(residents) AS a FROM v_home GROUP BY 1) t USING (zone) LEFT JOIN (SELECT zone, sum(places) AS total FROM v_service GROUP BY 1) s USING (zone) WHERE s.total IS NOT NULL")
def areal_apportionment(spark: SparkSession, d: str) -> DataFrame:
    """Each zone's places shared over its homes by residents."""
    totals = VIEWS["v_service"](spark, d).groupBy("zone").agg(F.sum("places").alias("total"))
    homes = VIEWS["v_home"](spark, d)
    return apportion(homes.join(totals.select("zone"), "zone", "left_semi"), totals, "zone", "residents", "total").select("id", F.round("value", 4).alias("value"))


@query("SELECT o_zone AS zone, arg_min(d_zone, row(-round(w, 6), d_zone)) AS winner, round(max(w), 4) AS weight FROM (SELECT o_zone, d_zone, sum(weight) AS w FROM v_trip GROUP BY 1, 2) GROUP BY 1")
def majority_zone(spark: SparkSession, d: str) -> DataFrame:
    """The destination with most trips from each zone."""
    m = majority(VIEWS["v_trip"](spark, d), ["o_zone"], "d_zone", "weight")
    return m.select(F.col("o_zone").alias("zone"), F.col("d_zone").alias("winner"), F.round("weight", 4).alias("weight"))


@query("SELECT edge_id, round(sum(w), 4) AS w, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM (SELECT c_nationkey AS edge_id, greatest(c_acctbal, 0) AS w, 'base' AS origin FROM customer UNION ALL SELECT s_nationkey, greatest(s_acctbal, 0), 'added' FROM supplier) GROUP BY 1")
def union_merge_demand(spark: SparkSession, d: str) -> DataFrame:
    """Two sources with a flag, merged by key."""
    base = table(spark, d, "customer").select(F.col("c_nationkey").alias("edge_id"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("w"), F.lit("base").alias("origin"))
    added = table(spark, d, "supplier").select(F.col("s_nationkey").alias("edge_id"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("w"), F.lit("added").alias("origin"))
    return base.unionByName(added).groupBy("edge_id").agg(F.round(F.sum("w"), 4).alias("w"), F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"))


@query("SELECT k, 'both' AS part FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT k, 'customers' FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT k, 'either' FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    part = lambda df, name: df.withColumn("part", F.lit(name))
    return part(a.intersect(b), "both").union(part(a.subtract(b), "customers")).union(part(a.union(b).distinct(), "either"))


@query("SELECT vehicle, edge_id, row_number() OVER (PARTITION BY vehicle ORDER BY first) AS place FROM (SELECT vehicle, edge_id, min(pass_id) AS first FROM v_pass GROUP BY 1, 2)")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges of each vehicle in order of first sight."""
    first = VIEWS["v_pass"](spark, d).groupBy("vehicle", "edge_id").agg(F.min("pass_id").alias("first"))
    return first.select("vehicle", "edge_id", F.row_number().over(Window.partitionBy("vehicle").orderBy("first")).cast("long").alias("place"))


@query("SELECT edge_id, count(*) AS vehicles, min(vehicle) AS lowest FROM (SELECT DISTINCT edge_id, vehicle FROM v_pass) GROUP BY 1")
def select_link_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct vehicles of each edge."""
    return VIEWS["v_pass"](spark, d).dropDuplicates(["edge_id", "vehicle"]).groupBy("edge_id").agg(F.count(F.lit(1)).alias("vehicles"), F.min("vehicle").alias("lowest"))


@query("SELECT edge_id, kind, kmh, pass_id FROM (SELECT *, row_number() OVER (PARTITION BY edge_id, kind ORDER BY ts DESC, pass_id DESC) AS r FROM v_pass) WHERE r = 1 AND kind <> 'error'")
def edit_last_writer_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last edit of each target; targets last marked as errors go."""
    p = VIEWS["v_pass"](spark, d)
    last = p.groupBy("edge_id", "kind").agg(F.max_by(F.struct("kmh", "pass_id"), F.struct("ts", "pass_id")).alias("e"))
    return last.where("kind <> 'error'").select("edge_id", "kind", "e.kmh", "e.pass_id")


@query("SELECT p.p_partkey AS edge_id FROM part p WHERE NOT EXISTS (SELECT 1 FROM v_pass q WHERE q.edge_id = p.p_partkey)")
def missing_targets(spark: SparkSession, d: str) -> DataFrame:
    """Edges that no pass names."""
    return VIEWS["v_edge"](spark, d).join(VIEWS["v_pass"](spark, d).select("edge_id").distinct(), "edge_id", "left_anti").select("edge_id")
