"""Windows: deltas, rolling hours, islands, interpolation, smoothing, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanspark.operators.sequences import beside, collapse, counter_deltas, islands, sessions, trailing
from urbanspark.registry import query
from urbanspark.sources.views import VIEWS, table


@query("SELECT pass_id, edge_id, c AS counter, CASE WHEN b IS NULL OR c < b THEN c ELSE c - b END AS delta FROM (SELECT *, lag(c) OVER (PARTITION BY edge_id ORDER BY ts, pass_id) AS b FROM (SELECT pass_id, edge_id, ts, (pass_id * 37) % 1000 AS c FROM v_pass))")
def hourly_counter_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Increases of a counter that resets."""
    p = VIEWS["v_pass"](spark, d).select("pass_id", "edge_id", "ts", ((F.col("pass_id") * 37) % 1000).alias("counter"))
    return counter_deltas(p, ["edge_id"], ["ts", "pass_id"], "counter", F.date_trunc("hour", "ts")).select("pass_id", "edge_id", "counter", "delta")


@query("SELECT trip, seq, CAST(sum(stop - 25) OVER (PARTITION BY trip ORDER BY seq) AS BIGINT) AS x FROM v_stop_time")
def ring_decode(spark: SparkSession, d: str) -> DataFrame:
    """Positions from steps: a running sum along each sequence."""
    w = Window.partitionBy("trip").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return VIEWS["v_stop_time"](spark, d).select("trip", "seq", F.sum(F.col("stop") - 25).over(w).alias("x"))


@query("SELECT trip, seq, stop, coalesce(lead(stop) OVER w, first_value(stop) OVER w) AS next_stop FROM v_stop_time WINDOW w AS (PARTITION BY trip ORDER BY seq)")
def next_with_wrap(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("trip").orderBy("seq")
    return VIEWS["v_stop_time"](spark, d).select("trip", "seq", "stop", F.coalesce(F.lead("stop").over(w), F.first("stop").over(w)).alias("next_stop"))


@query("SELECT pass_id, edge_id, count(*) OVER w AS n, round(avg(kmh) OVER w, 6) AS kmh FROM v_pass WINDOW w AS (PARTITION BY edge_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def rolling_last_hour(spark: SparkSession, d: str) -> DataFrame:
    """Passes and mean speed of an edge in the hour up to each pass."""
    hour = 3_600_000_000
    p = trailing(VIEWS["v_pass"](spark, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), ["edge_id"], F.col("at"), hour)
    w = Window.partitionBy("edge_id", "_slot").orderBy("at").rangeBetween(-hour, 0)
    return p.select("pass_id", "edge_id", "_own", F.count(F.lit(1)).over(w).alias("n"), F.round(F.avg("kmh").over(w), 6).alias("kmh")).where("_own").drop("_own")


@query("SELECT vehicle, CAST(min(d) AS BIGINT) AS first, CAST(max(d) AS BIGINT) AS last, count(*) AS days FROM (SELECT vehicle, d, d - row_number() OVER (PARTITION BY vehicle ORDER BY d) AS g FROM (SELECT DISTINCT vehicle, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS d FROM v_pass)) GROUP BY vehicle, g")
def balance_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive days on which a vehicle passes."""
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    return islands(VIEWS["v_pass"](spark, d), ["vehicle"], day).select("vehicle", "first", "last", "days")


@query("SELECT edge_id, round(avg(v) FILTER (r1 <= 2), 6) AS first_two, round(avg(v) FILTER (r2 <= 2), 6) AS last_two FROM (SELECT edge_id, v, row_number() OVER (PARTITION BY edge_id ORDER BY d) AS r1, row_number() OVER (PARTITION BY edge_id ORDER BY d DESC) AS r2 FROM (SELECT edge_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS d, avg(kmh) AS v FROM v_pass GROUP BY 1, 2)) GROUP BY 1")
def first_last_two_days(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    days = VIEWS["v_pass"](spark, d).groupBy("edge_id", day.alias("d")).agg(F.avg("kmh").alias("v"))
    w = Window.partitionBy("edge_id")
    ranked = days.withColumns({"r1": F.row_number().over(w.orderBy("d")), "r2": F.row_number().over(w.orderBy(F.desc("d")))})
    mean = lambda r: F.round(F.avg(F.when(F.col(r) <= 2, F.col("v"))), 6)
    return ranked.groupBy("edge_id").agg(mean("r1").alias("first_two"), mean("r2").alias("last_two"))


@query("SELECT src, arg_min(dst, row(cost, dst)) AS dst, min(cost) AS cost, CAST(bit_or(1 << (dst % 8)) AS BIGINT) AS mask FROM (SELECT src, CAST(dst AS BIGINT) AS dst, cost FROM v_arc) GROUP BY 1")
def cheapest_arc(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest arc from each node, and the classes of all its arcs as a bit set."""
    a = VIEWS["v_arc"](spark, d).withColumn("dst", F.col("dst").cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("dst") % 8).cast("int"))
    return a.groupBy("src").agg(F.min_by("dst", F.struct("cost", "dst")).alias("dst"), F.min("cost").alias("cost"), F.bit_or(bit).alias("mask"))


@query("SELECT trip, seq, stop FROM (SELECT *, lag(stop) OVER (PARTITION BY trip ORDER BY seq) AS b FROM v_stop_time) WHERE b IS DISTINCT FROM stop")
def collapse_repeats(spark: SparkSession, d: str) -> DataFrame:
    return collapse(VIEWS["v_stop_time"](spark, d), ["trip"], ["seq"], "stop").select("trip", "seq", "stop")


@query("SELECT vehicle, round(sum(step), 4) AS metres FROM (SELECT vehicle, abs(kmh - lag(kmh) OVER (PARTITION BY vehicle ORDER BY ts, pass_id)) AS step FROM v_pass) GROUP BY 1")
def sequence_distance(spark: SparkSession, d: str) -> DataFrame:
    """Length of each vehicle's path through its speeds."""
    w = Window.partitionBy("vehicle").orderBy("ts", "pass_id")
    p = VIEWS["v_pass"](spark, d).withColumn("step", F.abs(F.col("kmh") - F.lag("kmh").over(w)))
    return p.groupBy("vehicle").agg(F.round(F.sum("step"), 4).alias("metres"))


@query("SELECT edge_id, arg_max(h, row(n, -h)) FILTER (h BETWEEN 5 AND 10) AS morning, arg_max(h, row(n, -h)) FILTER (h BETWEEN 12 AND 19) AS evening FROM (SELECT edge_id, CAST(hour(ts) AS BIGINT) AS h, count(*) AS n FROM v_pass GROUP BY 1, 2) GROUP BY 1")
def peak_hours(spark: SparkSession, d: str) -> DataFrame:
    n = VIEWS["v_pass"](spark, d).groupBy("edge_id", F.hour("ts").cast("long").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    best = lambda low, high: F.max_by(F.when(F.col("h").between(low, high), F.col("h")), F.when(F.col("h").between(low, high), F.struct("n", -F.col("h"))))
    return n.groupBy("edge_id").agg(best(5, 10).alias("morning"), best(12, 19).alias("evening"))


@query("WITH p AS (SELECT CAST(hour(ts) AS BIGINT) AS h, avg(kmh) AS v FROM v_pass GROUP BY 1) SELECT a.h * 60 + m AS minute, round(a.v + (b.v - a.v) * m / 60.0, 6) AS v FROM p a JOIN p b ON b.h = (a.h + 1) % 24, (SELECT unnest([0, 15, 30, 45]) AS m)")
def profile_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """The hourly profile every quarter of an hour, around midnight too."""
    p = VIEWS["v_pass"](spark, d).groupBy(F.hour("ts").cast("long").alias("h")).agg(F.avg("kmh").alias("v"))
    w = Window.orderBy("h")  # 24 rows
    nxt = p.withColumn("n", F.coalesce(F.lead("v").over(w), F.first("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    m = nxt.withColumn("m", F.explode(F.array(*map(F.lit, (0, 15, 30, 45)))))
    return m.select((F.col("h") * 60 + F.col("m")).alias("minute"), F.round(F.col("v") + (F.col("n") - F.col("v")) * F.col("m") / 60.0, 6).alias("v"))


@query("SELECT vehicle, start, \"end\", n FROM (SELECT vehicle, s, CAST(min(t) AS BIGINT) AS start, CAST(max(t) AS BIGINT) AS \"end\", count(*) AS n FROM (SELECT vehicle, t, sum(f) OVER (PARTITION BY vehicle ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT vehicle, t, CASE WHEN t - lag(t) OVER (PARTITION BY vehicle ORDER BY t) <= 21600 THEN 0 ELSE 1 END AS f FROM (SELECT vehicle, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM v_pass))) GROUP BY 1, 2)")
def stuck_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a vehicle with gaps of at most six hours."""
    t = F.unix_seconds(F.col("ts").cast("timestamp"))
    return sessions(VIEWS["v_pass"](spark, d), ["vehicle"], t, 21_600).select("vehicle", "start", "end", "n")


@query("SELECT vehicle, pass_id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle, b ORDER BY ts, pass_id) AS r, dense_rank() OVER (PARTITION BY vehicle ORDER BY b DESC) AS k FROM (SELECT *, CAST(floor(epoch(ts) / 600) AS BIGINT) AS b FROM v_pass)) WHERE r = 1 AND k <= 40")
def downsample(spark: SparkSession, d: str) -> DataFrame:
    """One sample per ten minutes, the last 40 of each vehicle."""
    p = VIEWS["v_pass"](spark, d).withColumn("b", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600))
    one = p.groupBy("vehicle", "b").agg(F.min_by("pass_id", F.struct("ts", "pass_id")).alias("pass_id"))
    return one.withColumn("k", F.row_number().over(Window.partitionBy("vehicle").orderBy(F.desc("b")))).where("k <= 40").select("vehicle", "pass_id")


@query("SELECT pass_id, edge_id, lead(vehicle) OVER (PARTITION BY edge_id ORDER BY ts, pass_id) AS leader, round(lead(kmh) OVER (PARTITION BY edge_id ORDER BY ts, pass_id) - kmh, 6) AS gap FROM v_pass")
def leader_follower(spark: SparkSession, d: str) -> DataFrame:
    p = beside(VIEWS["v_pass"](spark, d), ["edge_id"], ["ts", "pass_id"], F.date_trunc("hour", "ts"), ["vehicle", "kmh"], ahead=True)
    return p.select("pass_id", "edge_id", F.col("other_vehicle").alias("leader"), F.round(F.col("other_kmh") - F.col("kmh"), 6).alias("gap"))


@query("SELECT vehicle, pass_id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY ts DESC, pass_id DESC) AS r FROM v_pass) WHERE r <= 10")
def last_rows(spark: SparkSession, d: str) -> DataFrame:
    """The last ten passes of each vehicle."""
    w = Window.partitionBy("vehicle").orderBy(F.desc("ts"), F.desc("pass_id"))
    return VIEWS["v_pass"](spark, d).withColumn("r", F.row_number().over(w)).where("r <= 10").select("vehicle", "pass_id")


@query("SELECT c_custkey AS id, c_mktsegment AS segment, row_number() OVER (ORDER BY c_mktsegment <> 'BUILDING', c_mktsegment, c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY place LIMIT 50")
def multi_key_sort(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 in an order with a favoured group."""
    first = table(spark, d, "customer").orderBy(F.col("c_mktsegment") != "BUILDING", "c_mktsegment", F.desc("c_acctbal"), "c_custkey").limit(50)
    w = Window.orderBy(F.col("segment") != "BUILDING", "segment", F.desc("c_acctbal"), "id")  # 50 rows
    return first.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), "c_acctbal").withColumn("place", F.row_number().over(w).cast("long")).drop("c_acctbal")
