"""Speeds, fit of modelled to counted traffic, comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanspark.functions.formulas import geh, relative_change
from urbanspark.functions.rules import change_band, road_class, speed_band
from urbanspark.operators.aggregates import pass_shares, weighted_mean
from urbanspark.registry import query
from urbanspark.sources.views import VIEWS, table

_BAND = "CASE WHEN s IS NULL THEN 'none' WHEN s >= 0.7 THEN 'flowing' WHEN s >= 0.45 THEN 'slow' WHEN s >= 0.2 THEN 'congested' ELSE 'jammed' END"
_SHARES = "SELECT e.road, e.edge_id, e.length, p.ts, p.kmh, CAST(hour(p.ts) AS BIGINT) AS h, least(p.kmh / e.limit_kmh, 1.0) AS share FROM v_pass p JOIN v_edge e USING (edge_id)"


@query(f"SELECT road, h AS hour, n, round(s, 6) AS share, {_BAND} AS band FROM (SELECT road, h, count(*) AS n, round(sum(share * length) / sum(length), 6) AS s FROM ({_SHARES}) GROUP BY road, h)")
def road_speed_by_hour(spark: SparkSession, d: str) -> DataFrame:
    """Length-weighted speed share and band of each road and hour."""
    p = pass_shares(VIEWS["v_pass"](spark, d), VIEWS["v_edge"](spark, d))
    out = p.groupBy("road", "hour").agg(F.count(F.lit(1)).alias("n"), F.round(weighted_mean(F.col("share"), F.col("length")), 6).alias("share"))
    return out.withColumn("band", speed_band(F.col("share")))


@query(f"SELECT h AS hour, round(sum(CASE WHEN s < 0.45 THEN length ELSE 0 END) / sum(length), 6) AS congested FROM (SELECT edge_id, h, any_value(length) AS length, avg(share) AS s FROM ({_SHARES}) GROUP BY edge_id, h) GROUP BY h")
def congested_length_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of the driven length that is congested, by hour."""
    p = pass_shares(VIEWS["v_pass"](spark, d), VIEWS["v_edge"](spark, d))
    edges = p.groupBy("edge_id", "hour").agg(F.first("length").alias("length"), F.avg("share").alias("s"))
    return edges.groupBy("hour").agg(F.round(F.sum(F.when(F.col("s") < 0.45, F.col("length")).otherwise(0.0)) / F.sum("length"), 6).alias("congested"))


@query("SELECT e.edge_id, e.road, round(avg(CASE WHEN p.kmh IS NOT NULL THEN least(p.kmh / e.limit_kmh, 1.0) END), 6) AS share, count(p.pass_id) AS passes, CASE WHEN e.limit_kmh >= 100 THEN 'motorway' WHEN e.limit_kmh >= 80 THEN 'state' WHEN e.limit_kmh >= 50 THEN 'main' ELSE 'local' END AS class FROM v_edge e LEFT JOIN v_pass p USING (edge_id) GROUP BY e.edge_id, e.road, e.limit_kmh")
def edge_day_share(spark: SparkSession, d: str) -> DataFrame:
    """Every edge's mean share; NULL where nobody drove."""
    e, p = VIEWS["v_edge"](spark, d), VIEWS["v_pass"](spark, d)
    by_edge = p.join(e.select("edge_id", "limit_kmh"), "edge_id").groupBy("edge_id").agg(F.round(F.avg(F.least(F.col("kmh") / F.col("limit_kmh"), F.lit(1.0))), 6).alias("share"), F.count(F.lit(1)).alias("passes"))
    return e.join(by_edge, "edge_id", "left").select("edge_id", "road", "share", F.coalesce("passes", F.lit(0).cast("long")).alias("passes"), road_class(F.col("limit_kmh")).alias("class"))


_GEH = "CASE WHEN counted + model = 0 THEN 0 ELSE sqrt(2 * pow(model - counted, 2) / nullif(counted + model, 0)) END"


@query(f"SELECT station, counted, model, round({_GEH}, 6) AS geh, round(CASE WHEN counted = 0 AND model = 0 THEN 0 ELSE (model - counted) / nullif(counted, 0) END, 6) AS change FROM v_count")
def geh_by_station(spark: SparkSession, d: str) -> DataFrame:
    c = VIEWS["v_count"](spark, d)
    return c.select("station", "counted", "model", F.round(geh(F.col("model"), F.col("counted")), 6).alias("geh"), F.round(relative_change(F.col("counted"), F.col("model")), 6).alias("change"))


@query(f"SELECT district, count(*) AS stations, CAST(count(*) FILTER (abs(model - counted) <= 0.25 * counted) AS BIGINT) AS within, round(avg(abs(model - counted) / nullif(counted, 0)), 6) AS mape, round(sum(model) / nullif(sum(counted), 0), 6) AS ratio, round(avg(CASE WHEN {_GEH} < 5 THEN 1.0 ELSE 0.0 END), 6) AS geh_ok FROM v_count JOIN supplier ON station = s_suppkey JOIN v_zone ON s_nationkey = zone GROUP BY GROUPING SETS ((district), ())")
def fit_summary_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Stations within a quarter, mean error, ratio and GEH pass rate, by district and in all."""
    s, z = table(spark, d, "supplier"), VIEWS["v_zone"](spark, d)
    c = VIEWS["v_count"](spark, d).join(s.select(F.col("s_suppkey").alias("station"), F.col("s_nationkey").cast("int").alias("zone")), "station").join(F.broadcast(z), "zone")
    off = F.abs(F.col("model") - F.col("counted"))
    return c.rollup("district").agg(
        F.count(F.lit(1)).alias("stations"),
        F.count(F.when(off <= 0.25 * F.col("counted"), 1)).alias("within"),
        F.round(F.avg(off / F.nullif(F.col("counted"), F.lit(0.0))), 6).alias("mape"),
        F.round(F.try_divide(F.sum("model"), F.sum("counted")), 6).alias("ratio"),
        F.round(F.avg(F.when(geh(F.col("model"), F.col("counted")) < 5, 1.0).otherwise(0.0)), 6).alias("geh_ok"),
    )


@query("SELECT hour, count(*) AS stations, round(avg(CASE WHEN g < 5 THEN 1.0 ELSE 0.0 END), 6) AS share, avg(CASE WHEN g < 5 THEN 1.0 ELSE 0.0 END) >= 0.85 AS passed FROM (SELECT station, hour, CASE WHEN b + a = 0 THEN 0 ELSE sqrt(2 * pow(a - b, 2) / nullif(b + a, 0)) END AS g FROM (SELECT edge_id AS station, CAST((minute // 60) % 24 AS BIGINT) AS hour, CAST(count(*) FILTER (run = 'before') AS DOUBLE) AS b, CAST(count(*) FILTER (run = 'after') AS DOUBLE) AS a FROM v_run GROUP BY 1, 2)) GROUP BY hour")
def geh_hours(spark: SparkSession, d: str) -> DataFrame:
    """Share of station-hours with GEH under 5, and whether the hour passes."""
    r = VIEWS["v_run"](spark, d).groupBy(F.col("edge_id").alias("station"), (F.floor(F.col("minute") / 60) % 24).alias("hour"))
    g = r.agg(F.count(F.when(F.col("run") == "before", 1)).cast("double").alias("b"), F.count(F.when(F.col("run") == "after", 1)).cast("double").alias("a")).withColumn("g", geh(F.col("a"), F.col("b")))
    ok = F.avg(F.when(F.col("g") < 5, 1.0).otherwise(0.0))
    return g.groupBy("hour").agg(F.count(F.lit(1)).alias("stations"), F.round(ok, 6).alias("share"), (ok >= 0.85).alias("passed"))


@query("SELECT o_orderpriority AS priority, round(median(v), 6) AS factor FROM (SELECT o_orderpriority, o_orderdate, sum(o_totalprice) / avg(sum(o_totalprice)) OVER (PARTITION BY o_orderpriority) AS v, dayofweek(o_orderdate) AS w FROM orders GROUP BY 1, 2) WHERE w BETWEEN 1 AND 5 GROUP BY 1")
def workday_factor_median(spark: SparkSession, d: str) -> DataFrame:
    """Median ratio of a working day's total to the average day."""
    days = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), "o_orderdate").agg(F.sum("o_totalprice").alias("t"))
    ratio = days.withColumn("v", F.col("t") / F.avg("t").over(Window.partitionBy("priority")))
    return ratio.where(F.dayofweek("o_orderdate").between(2, 6)).groupBy("priority").agg(F.round(F.median("v"), 6).alias("factor"))


_RUNS = "SELECT edge_id, CAST((minute // 60) % 24 AS BIGINT) AS hour, avg(kmh) FILTER (run = 'before') AS b, avg(kmh) FILTER (run = 'after') AS a FROM v_run GROUP BY 1, 2"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    r = VIEWS["v_run"](spark, d).groupBy("edge_id", (F.floor(F.col("minute") / 60) % 24).alias("hour"))
    return r.agg(F.avg(F.when(F.col("run") == "before", F.col("kmh"))).alias("b"), F.avg(F.when(F.col("run") == "after", F.col("kmh"))).alias("a"))


@query(f"SELECT edge_id, hour, round(a - b, 6) AS gain FROM ({_RUNS}) WHERE b > 0 AND a > 0 ORDER BY round(a - b, 6) DESC, edge_id, hour LIMIT 25")
def run_comparison_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 25 edge-hours that gained most between two runs that both reach them."""
    both = _runs(spark, d).where("b > 0 and a > 0").select("edge_id", "hour", F.round(F.col("a") - F.col("b"), 6).alias("gain"))
    return both.orderBy(F.desc("gain"), "edge_id", "hour").limit(25)


@query("SELECT edge_id, b, a, band FROM (SELECT *, CASE WHEN greatest(a, b) < 20 THEN NULL WHEN (a - b) / greatest(b, 1) >= 0.3 THEN 'much more' WHEN (a - b) / greatest(b, 1) >= 0.1 THEN 'more' WHEN (a - b) / greatest(b, 1) <= -0.3 THEN 'much less' WHEN (a - b) / greatest(b, 1) <= -0.1 THEN 'less' END AS band FROM (SELECT edge_id, CAST(count(*) FILTER (run = 'before') AS DOUBLE) AS b, CAST(count(*) FILTER (run = 'after') AS DOUBLE) AS a FROM v_run GROUP BY 1)) WHERE band IS NOT NULL")
def diff_bands(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose traffic changed, with the band of the change."""
    n = lambda run: F.count(F.when(F.col("run") == run, 1)).cast("double")
    r = VIEWS["v_run"](spark, d).groupBy("edge_id").agg(n("before").alias("b"), n("after").alias("a"))
    return r.withColumn("band", change_band(F.col("b"), F.col("a"), 20.0)).where("band is not null").select("edge_id", "b", "a", "band")


@query("SELECT edge_id, max(minute) AS minute FROM (SELECT edge_id, minute FROM v_run WHERE run = 'before' INTERSECT SELECT edge_id, minute // 1 FROM v_run WHERE run = 'after') GROUP BY 1 UNION ALL SELECT CAST(-1 AS BIGINT), max(minute) FROM (SELECT minute // 1440 AS minute FROM v_run WHERE run = 'before' INTERSECT SELECT minute // 1440 FROM v_run WHERE run = 'after')")
def latest_common_minute(spark: SparkSession, d: str) -> DataFrame:
    """Latest minute that both runs have for an edge; edge -1: the latest common day."""
    r = VIEWS["v_run"](spark, d)
    part = lambda run, *c: r.where(F.col("run") == run).select(*c)
    common = part("before", "edge_id", "minute").intersect(part("after", "edge_id", "minute")).groupBy("edge_id").agg(F.max("minute").alias("minute"))
    day = F.floor(F.col("minute") / 1440).alias("minute")
    days = part("before", day).intersect(part("after", day)).agg(F.max("minute").alias("minute")).select(F.lit(-1).cast("long").alias("edge_id"), "minute")
    return common.unionByName(days)


@query("SELECT count(*) AS passes, count(DISTINCT vehicle) AS vehicles, round(avg(kmh), 6) AS mean_kmh, CAST(count(*) FILTER (kind = 'error') AS BIGINT) AS errors, round(sum(CASE WHEN kmh > 50 THEN 1.0 ELSE 0.0 END) / count(*), 6) AS fast FROM v_pass")
def network_statistics(spark: SparkSession, d: str) -> DataFrame:
    """One row of totals over all passes."""
    return VIEWS["v_pass"](spark, d).agg(
        F.count(F.lit(1)).alias("passes"), F.countDistinct("vehicle").alias("vehicles"), F.round(F.avg("kmh"), 6).alias("mean_kmh"), F.count(F.when(F.col("kind") == "error", 1)).alias("errors"), F.round(F.avg(F.when(F.col("kmh") > 50, 1.0).otherwise(0.0)), 6).alias("fast")
    )


@query("SELECT edge_id, CASE WHEN min(n) > 0 THEN round(avg(n), 6) END AS mean, round(coalesce(stddev_pop(n), 0), 6) AS noise FROM (SELECT e.edge_id, s.seed, CAST(count(p.pass_id) AS DOUBLE) AS n FROM v_edge e CROSS JOIN (VALUES (0), (1), (2)) s(seed) LEFT JOIN v_pass p ON p.edge_id = e.edge_id AND p.vehicle % 3 = s.seed GROUP BY 1, 2) GROUP BY 1")
def run_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean and noise over three seeds; no mean where a seed has nothing."""
    n = VIEWS["v_pass"](spark, d).groupBy("edge_id", (F.col("vehicle") % 3).alias("seed")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    seeds = VIEWS["v_edge"](spark, d).select("edge_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("seed"))
    full = seeds.join(n, ["edge_id", "seed"], "left").na.fill({"n": 0.0})
    return full.groupBy("edge_id").agg(F.when(F.min("n") > 0, F.round(F.avg("n"), 6)).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("noise"))


@query("SELECT kind, round(sum(euros * weight) / greatest(sum(weight), 1), 6) AS mean_cost, round(sum(weight), 6) AS trips FROM v_trip GROUP BY kind")
def before_after_totals(spark: SparkSession, d: str) -> DataFrame:
    """Trip-weighted mean cost by group."""
    w = F.sum("weight")
    return VIEWS["v_trip"](spark, d).groupBy("kind").agg(F.round(F.sum(F.col("euros") * F.col("weight")) / F.greatest(w, F.lit(1.0)), 6).alias("mean_cost"), F.round(w, 6).alias("trips"))


@query("SELECT road, round(sum(n * length) / 1000, 6) AS vehicle_km FROM (SELECT edge_id, count(*) AS n FROM v_pass GROUP BY 1) JOIN v_edge USING (edge_id) WHERE length < 1500 GROUP BY road HAVING sum(n * length) / 1000 >= 50")
def road_vehicle_km(spark: SparkSession, d: str) -> DataFrame:
    """Vehicle kilometres of each road's short edges, roads of 50 or more."""
    n = VIEWS["v_pass"](spark, d).groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"))
    km = n.join(VIEWS["v_edge"](spark, d).where("length < 1500"), "edge_id").groupBy("road").agg((F.sum(F.col("n") * F.col("length")) / 1000).alias("km"))
    return km.where("km >= 50").select("road", F.round("km", 6).alias("vehicle_km"))


@query("SELECT e.road || ' / ' || e.type AS place, count(*) AS removed FROM v_pass p JOIN v_edge e USING (edge_id) WHERE p.kind = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def stuck_places(spark: SparkSession, d: str) -> DataFrame:
    """Removed vehicles by composed place name, the 25 worst."""
    p = VIEWS["v_pass"](spark, d).where("kind = 'error'").join(VIEWS["v_edge"](spark, d), "edge_id")
    return p.groupBy(F.concat_ws(" / ", "road", "type").alias("place")).agg(F.count(F.lit(1)).alias("removed")).orderBy(F.desc("removed"), "place").limit(25)


@query("SELECT edge_id, round(sum(lost), 4) AS lost, round(sum(lost) FILTER (kind = 'view'), 4) AS view, round(sum(lost) FILTER (kind = 'click'), 4) AS click FROM (SELECT edge_id, kind, greatest(limit_kmh - kmh, 0) AS lost FROM v_pass JOIN v_edge USING (edge_id)) GROUP BY 1 ORDER BY round(sum(lost), 4) DESC, edge_id LIMIT 20")
def lost_time_top(spark: SparkSession, d: str) -> DataFrame:
    """The 20 edges with most lost speed and its parts by cause."""
    p = VIEWS["v_pass"](spark, d).join(VIEWS["v_edge"](spark, d), "edge_id").withColumn("lost", F.greatest(F.col("limit_kmh") - F.col("kmh"), F.lit(0.0)))
    of = lambda k: F.round(F.sum(F.when(F.col("kind") == k, F.col("lost"))), 4).alias(k)
    return p.groupBy("edge_id").agg(F.round(F.sum("lost"), 4).alias("lost"), of("view"), of("click")).orderBy(F.desc("lost"), "edge_id").limit(20)


@query("SELECT edge_id, round(avg(kmh), 6) AS mean, max(kmh) AS worst, quantile_disc(kmh, 0.95) AS p95 FROM v_pass WHERE hour(ts) BETWEEN 7 AND 9 GROUP BY 1")
def window_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Mean, worst and 95th percentile of the morning."""
    p = VIEWS["v_pass"](spark, d).where(F.hour("ts").between(7, 9))
    return p.groupBy("edge_id").agg(F.round(F.avg("kmh"), 6).alias("mean"), F.max("kmh").alias("worst"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY kmh)").alias("p95"))


@query("SELECT e.road, round(avg(CASE WHEN p.edge_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS covered FROM v_edge e LEFT JOIN (SELECT DISTINCT edge_id FROM v_pass) p USING (edge_id) GROUP BY 1")
def line_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of each road's edges with a pass."""
    seen = VIEWS["v_pass"](spark, d).select("edge_id").distinct().withColumn("hit", F.lit(1.0))
    return VIEWS["v_edge"](spark, d).join(seen, "edge_id", "left").groupBy("road").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("covered"))


@query(f"SELECT edge_id, round(avg(s), 6) AS share FROM (SELECT edge_id, h, avg(share) AS s FROM ({_SHARES}) WHERE h BETWEEN 7 AND 9 OR h BETWEEN 15 AND 17 GROUP BY 1, 2) GROUP BY 1 HAVING avg(s) < 0.9")
def peak_speed_share(spark: SparkSession, d: str) -> DataFrame:
    """Mean share over the peak hours, where it is under nine tenths."""
    p = pass_shares(VIEWS["v_pass"](spark, d), VIEWS["v_edge"](spark, d)).where("hour between 7 and 9 or hour between 15 and 17")
    return p.groupBy("edge_id", "hour").agg(F.avg("share").alias("s")).groupBy("edge_id").agg(F.avg("s").alias("s")).where("s < 0.9").select("edge_id", F.round("s", 6).alias("share"))


@query("SELECT coalesce(a.edge_id, b.edge_id) AS edge_id, coalesce(a.n, 0) AS today, coalesce(b.n, 0) AS project FROM (SELECT edge_id, count(*) AS n FROM v_run WHERE run = 'before' AND kmh > 200 GROUP BY 1) a FULL JOIN (SELECT edge_id, count(*) AS n FROM v_run WHERE run = 'after' AND kmh > 200 GROUP BY 1) b ON a.edge_id = b.edge_id")
def outer_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Full outer join of two runs, missing as 0."""
    r = VIEWS["v_run"](spark, d).where("kmh > 200")
    part = lambda run, name: r.where(F.col("run") == run).groupBy("edge_id").agg(F.count(F.lit(1)).alias(name))
    return part("before", "today").join(part("after", "project"), "edge_id", "full").na.fill(0, ["today", "project"])
