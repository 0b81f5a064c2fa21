"""Demand, mode choice, charges, land value, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanspark.functions.formulas import gravity_weight, hash_uniform, in_daily_window, incremental_factor, logit_share
from urbanspark.registry import query
from urbanspark.sources.views import VIEWS, table

_DIST = "sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2))"
_U = "(((id * 1103515245 + {salt}) % 2147483648) * 69069 + 1) % 1000003 / 1000003.0"


def _zones(spark: SparkSession, d: str, key: str) -> DataFrame:
    return VIEWS["v_zone"](spark, d).select(F.col("zone").alias(f"{key}_zone"), F.col("x").alias(f"{key}x"), F.col("z").alias(f"{key}z"))


def _od_metres(spark: SparkSession, d: str) -> DataFrame:
    od = VIEWS["v_od"](spark, d)
    j = od.join(F.broadcast(_zones(spark, d, "o")), "o_zone").join(F.broadcast(_zones(spark, d, "d")), "d_zone")  # nations: a fixed, small table
    return j.select("o_zone", "d_zone", "trips", F.hypot(F.col("ox") - F.col("dx"), F.col("oz") - F.col("dz")).alias("m"))


_OD = f"SELECT o_zone, d_zone, trips, {_DIST} AS m FROM v_od JOIN v_zone a ON a.zone = o_zone JOIN v_zone b ON b.zone = d_zone"


@query(f"SELECT o_zone, d_zone, round(t * w / sum(w) OVER (PARTITION BY o_zone), 4) AS expected FROM (SELECT o_zone, d_zone, sum(trips) OVER (PARTITION BY o_zone) AS t, sum(trips) OVER (PARTITION BY d_zone) * exp(-m / 10000) * pow(greatest(m, 400) / 1000, -1) AS w FROM ({_OD}))")
def gravity_expected_od(spark: SparkSession, d: str) -> DataFrame:
    """Each zone's trips over the destinations by attraction and distance."""
    o, t = Window.partitionBy("o_zone"), Window.partitionBy("d_zone")
    w = _od_metres(spark, d).withColumns({"t": F.sum("trips").over(o), "a": F.sum("trips").over(t)}).withColumn("w", F.col("a") * gravity_weight(F.col("m")))
    return w.select("o_zone", "d_zone", F.round(F.col("t") * F.col("w") / F.sum("w").over(o), 4).alias("expected"))


_LOGIT = f"SELECT *, m / 8.0 AS car, m / 5.0 + 480 AS pt, 1 / (1 + exp(-(1.68 - 0.04 * ((m / 5.0 + 480) - m / 8.0) / 60))) AS s, 1 / (1 + exp(-(1.68 - 0.04 * ((m / 5.0 + 240) - m / 8.0) / 60))) AS s2 FROM ({_OD})"


def _shares(spark: SparkSession, d: str) -> DataFrame:
    m = _od_metres(spark, d).withColumns({"car": F.col("m") / 8.0, "pt": F.col("m") / 5.0 + 480})
    return m.withColumns({"s": logit_share(F.col("car"), F.col("pt")), "s2": logit_share(F.col("car"), F.col("m") / 5.0 + 240)})


@query(f"SELECT o_zone, d_zone, round(s, 6) AS share FROM ({_LOGIT})")
def logit_shares(spark: SparkSession, d: str) -> DataFrame:
    """Public transport's share of each pair."""
    return _shares(spark, d).select("o_zone", "d_zone", F.round("s", 6).alias("share"))


@query(f"SELECT o_zone, d_zone, round(least((1 - s2) / greatest(1 - s, 0.001), 2), 6) AS factor, round(trips * (1 - least((1 - s2) / greatest(1 - s, 0.001), 2)), 4) AS moved FROM ({_LOGIT})")
def incremental_logit_factor(spark: SparkSession, d: str) -> DataFrame:
    """What shorter waits take from the cars of each pair."""
    f = incremental_factor(F.col("s"), F.col("s2"))
    return _shares(spark, d).select("o_zone", "d_zone", F.round(f, 6).alias("factor"), F.round(F.col("trips") * (1 - f), 4).alias("moved"))


@query(f"SELECT o_zone, d_zone, round(trips / (1 - s) * s2, 4) AS pt_trips FROM ({_LOGIT})")
def transit_trips(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d).select("o_zone", "d_zone", F.round(F.col("trips") / (1 - F.col("s")) * F.col("s2"), 4).alias("pt_trips"))


@query("SELECT id, zone, round(p, 6) AS u FROM (SELECT k.id, k.p, z.zone, row_number() OVER (PARTITION BY k.id ORDER BY z.hi) AS r FROM (SELECT s_suppkey AS id, " + _U.format(salt=12345).replace("id *", "s_suppkey *") + " AS p FROM supplier) k JOIN (SELECT zone, sum(w) OVER (ORDER BY zone) / sum(w) OVER () AS hi FROM (SELECT zone, sum(residents) AS w FROM v_home GROUP BY 1)) z ON k.p < z.hi) WHERE r = 1")
def inverse_cdf_sample(spark: SparkSession, d: str) -> DataFrame:
    """A zone for each supplier, drawn by residents with a hash of its key: zones (a fixed, small table) as one sorted array."""
    w = VIEWS["v_home"](spark, d).groupBy("zone").agg(F.sum("residents").alias("w"))
    order = Window.orderBy("zone")  # one row a nation
    steps = w.select("zone", (F.sum("w").over(order) / F.sum("w").over(Window.partitionBy())).alias("hi")).agg(F.sort_array(F.collect_list(F.struct("hi", "zone"))).alias("steps"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).withColumn("u", hash_uniform(F.col("id")))
    drawn = s.crossJoin(F.broadcast(steps)).withColumn("zone", F.filter("steps", lambda x: F.col("u") < x["hi"])[0]["zone"])
    return drawn.where("zone is not null").select("id", "zone", F.round("u", 6).alias("u"))


@query("SELECT o_orderkey AS id, CAST(floor(c) - floor(coalesce(lag(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0)) AS BIGINT) AS departures FROM (SELECT o_orderkey, o_custkey, round(sum(0.37 * (1 + o_orderkey % 5)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS c FROM orders)")
def fractional_departures(spark: SparkSession, d: str) -> DataFrame:
    """Whole departures from fractional rates that add up."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.sum(0.37 * (1 + F.col("o_orderkey") % 5)).over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("c"))
    return o.select(F.col("o_orderkey").alias("id"), (F.floor("c") - F.floor(F.coalesce(F.lag("c").over(w), F.lit(0.0)))).cast("long").alias("departures"))


@query("SELECT edge_id, count(*) AS entries, count(DISTINCT vehicle) AS vehicles, round(sum(CASE kind WHEN 'purchase' THEN 4.0 WHEN 'click' THEN 1.5 ELSE 0.5 END)::DOUBLE, 4) AS euros FROM (SELECT *, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS s FROM v_pass) WHERE s >= 79200 OR s < 21600 GROUP BY 1")
def congestion_charge_receipts(spark: SparkSession, d: str) -> DataFrame:
    """A night charge by kind of vehicle, from 22:00 past midnight to 06:00."""
    second = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long")
    p = VIEWS["v_pass"](spark, d).where(in_daily_window(second, F.lit(79_200), F.lit(21_600)))
    fee = F.when(F.col("kind") == "purchase", 4.0).when(F.col("kind") == "click", 1.5).otherwise(0.5)
    return p.groupBy("edge_id").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("vehicle").alias("vehicles"), F.round(F.sum(fee), 4).alias("euros"))


@query("SELECT o_zone, d_zone, round(m / 8 + 225 * (CASE WHEN (a_in <> b_in) THEN 1.0 ELSE 0.0 END + CASE WHEN b_in THEN 0.5 ELSE 0 END), 4) AS cost FROM (SELECT o_zone, d_zone, m, (o_zone IN (6, 7, 8, 11, 12, 13, 16, 17, 18)) AS a_in, (d_zone IN (6, 7, 8, 11, 12, 13, 16, 17, 18)) AS b_in FROM (" + _OD + "))")
def policy_cost_by_od(spark: SparkSession, d: str) -> DataFrame:
    """Generalised cost with a cordon charge and parking inside it."""
    core = (6, 7, 8, 11, 12, 13, 16, 17, 18)
    a, b = F.col("o_zone").isin(*core), F.col("d_zone").isin(*core)
    euros = F.when(a != b, 1.0).otherwise(0.0) + F.when(b, 0.5).otherwise(0.0)
    return _od_metres(spark, d).select("o_zone", "d_zone", F.round(F.col("m") / 8 + 225 * euros, 4).alias("cost"))


@query("SELECT h.h AS hour, round(sum(share * CASE WHEN (h.h BETWEEN 8 AND 15 AND flag = 'A') OR (h.h BETWEEN 16 AND 20 AND flag = 'N') THEN 1.2 ELSE 0.3 END), 6) AS expected FROM (SELECT unnest(range(0, 24)) AS h) h CROSS JOIN (SELECT l_returnflag AS flag, sum(l_quantity) / sum(sum(l_quantity)) OVER () AS share FROM lineitem GROUP BY 1) GROUP BY 1")
def parking_expectation(spark: SparkSession, d: str) -> DataFrame:
    """Expected payment of each hour over the shares of purposes."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum("l_quantity").alias("q"))
    s = s.withColumn("share", F.col("q") / F.sum("q").over(Window.partitionBy())).withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    busy = (F.col("hour").between(8, 15) & (F.col("flag") == "A")) | (F.col("hour").between(16, 20) & (F.col("flag") == "N"))
    return s.groupBy("hour").agg(F.round(F.sum(F.col("share") * F.when(busy, 1.2).otherwise(0.3)), 6).alias("expected"))


@query("SELECT c_custkey AS id, CASE WHEN u < 0.05 THEN 'lorry' WHEN u < 0.12 THEN 'van' WHEN u < 0.15 THEN 'bus' ELSE 'car' END AS kind FROM (SELECT c_custkey, " + _U.format(salt=12352).replace("id *", "c_custkey *") + " AS u FROM customer)")
def vehicle_kinds(spark: SparkSession, d: str) -> DataFrame:
    """A kind of vehicle for each customer by nested shares."""
    u = hash_uniform(F.col("c_custkey"), 7)
    kind = F.when(u < 0.05, "lorry").when(u < 0.12, "van").when(u < 0.15, "bus").otherwise("car")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), kind.alias("kind"))


@query("SELECT o_custkey AS id, o_orderkey AS step, round(sum(f) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS balance FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS f FROM orders)")
def budget_balance_history(spark: SparkSession, d: str) -> DataFrame:
    """Running balance of each account."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    flow = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("step"), F.round(F.sum(flow).over(w), 2).alias("balance"))


@query("SELECT l_returnflag AS kind, round(sum(CASE l_returnflag WHEN 'A' THEN l_quantity * 1.1 WHEN 'N' THEN l_quantity * p_size * 0.01 ELSE 5.6 END), 4) AS cost, round(sum(CASE WHEN l_returnflag = 'R' THEN 0.2 ELSE l_quantity * 0.02 END), 4) AS upkeep FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def edit_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost and upkeep of edits by their kind."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q, kind = F.col("l_quantity"), F.col("l_returnflag")
    cost = F.when(kind == "A", q * 1.1).when(kind == "N", q * F.col("p_size") * 0.01).otherwise(5.6)
    return j.groupBy(kind.alias("kind")).agg(F.round(F.sum(cost), 4).alias("cost"), F.round(F.sum(F.when(kind == "R", 0.2).otherwise(q * 0.02)), 4).alias("upkeep"))


@query("SELECT edge_id, round(avg(CASE WHEN hour(ts) BETWEEN 7 AND 8 THEN kmh END), 6) AS morning, round(avg(CASE WHEN hour(ts) BETWEEN 15 AND 17 THEN kmh END), 6) AS evening FROM v_pass GROUP BY 1")
def peak_meter(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda a, b: F.round(F.avg(F.when(F.hour("ts").between(a, b), F.col("kmh"))), 6)
    return VIEWS["v_pass"](spark, d).groupBy("edge_id").agg(mean(7, 8).alias("morning"), mean(15, 17).alias("evening"))


@query("SELECT zone, round(greatest(least(0.4 + (r - 300000) / 2000000, 1), -1), 6) AS demand FROM (SELECT zone, sum(residents) AS r FROM v_home GROUP BY 1)")
def zone_demand(spark: SparkSession, d: str) -> DataFrame:
    """Clamped linear demand of each zone."""
    r = VIEWS["v_home"](spark, d).groupBy("zone").agg(F.sum("residents").alias("r"))
    return r.select("zone", F.round(F.greatest(F.least(0.4 + (F.col("r") - 300_000) / 2_000_000, F.lit(1.0)), F.lit(-1.0)), 6).alias("demand"))


@query("SELECT w.state, e.road, round(avg(p.kmh * w.f), 6) AS kmh FROM v_pass p JOIN v_edge e USING (edge_id) CROSS JOIN (VALUES ('clear', 1.0), ('rain', 0.9), ('snow', 0.7)) w(state, f) GROUP BY 1, 2")
def weather_speeds(spark: SparkSession, d: str) -> DataFrame:
    """Mean speed of each road under each state of the weather."""
    mean = VIEWS["v_pass"](spark, d).join(VIEWS["v_edge"](spark, d), "edge_id").groupBy("road").agg(F.avg("kmh").alias("kmh"))
    states = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("f")) for s, f in (("clear", 1.0), ("rain", 0.9), ("snow", 0.7))])
    return mean.withColumn("w", F.explode(states)).select("w.state", "road", F.round(F.col("kmh") * F.col("w.f"), 6).alias("kmh"))
