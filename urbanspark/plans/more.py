"""Matching, demand over gateways, growth, policy and codec queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanspark.functions.formulas import GRS80_A, GRS80_F, degrees_of, transverse_mercator
from urbanspark.operators.growth import grown
from urbanspark.operators.matching import back_trace, first_spec, greedy_within, viterbi
from urbanspark.operators.spatial import spaced, within
from urbanspark.plans.measures import PROJECTED
from urbanspark.registry import query
from urbanspark.sources.views import VIEWS, table


@query(
    "WITH RECURSIVE pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.z - b.z, 2)), 6) AS dist FROM v_point a JOIN v_point b ON a.kind = 0 AND b.kind = 1 AND pow(a.x - b.x, 2) + pow(a.z - b.z, 2) <= 160000), "
    "ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY dist, a, b) AS k FROM pairs), "
    "pick(k, a, b, dist, taken, used_a, used_b) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, false, []::BIGINT[], []::BIGINT[] UNION ALL SELECT o.k, o.a, o.b, o.dist, free, CASE WHEN free THEN list_append(used_a, o.a) ELSE used_a END, CASE WHEN free THEN list_append(used_b, o.b) ELSE used_b END "
    "FROM (SELECT p.used_a, p.used_b, o.*, NOT list_contains(p.used_a, o.a) AND NOT list_contains(p.used_b, o.b) AS free FROM pick p JOIN ordered o ON o.k = p.k + 1) o) SELECT a, b, dist FROM pick WHERE taken"
)
def greedy_matching(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one pairs of points of two kinds, nearest first."""
    p = VIEWS["v_point"](spark, d)
    return greedy_within(p.where("kind = 0"), p.where("kind = 1"), 400.0)


@query(
    "WITH RECURSIVE near AS MATERIALIZED (SELECT a.id, list(b.id) AS ids FROM v_point a JOIN v_point b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.z - b.z, 2) <= 22500 GROUP BY 1), "
    "ordered AS MATERIALIZED (SELECT p.id, (p.id * 7919) % 1000 AS rank, coalesce(ids, []) AS ids, row_number() OVER (ORDER BY (p.id * 7919) % 1000, p.id) AS k FROM v_point p LEFT JOIN near USING (id)), "
    "pick(k, id, rank, stays, kept) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, false, []::BIGINT[] UNION ALL SELECT k, id, rank, free, CASE WHEN free THEN list_append(kept, id) ELSE kept END FROM (SELECT o.*, p.kept, NOT list_has_any(o.ids, p.kept) AS free FROM pick p JOIN ordered o ON o.k = p.k + 1)) "
    "SELECT id, rank FROM pick WHERE stays"
)
def conflict_elimination(spark: SparkSession, d: str) -> DataFrame:
    """Points that stay when of two within 150 m the one with the smaller rank wins."""
    return spaced(VIEWS["v_point"](spark, d).withColumn("rank", (F.col("id") * 7919) % 1000), 150.0).select("id", "rank")


@query("SELECT edge_id, spec, count(*) AS n FROM (SELECT *, min(spec) OVER (PARTITION BY edge_id) AS s FROM (SELECT edge_id, CASE WHEN kind = 'purchase' AND kmh > 300 THEN 1 WHEN kind = 'click' AND kmh > 300 THEN 2 ELSE 3 END AS spec FROM v_pass)) WHERE spec = s GROUP BY 1, 2")
def first_description(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the first description that resolves, per edge."""
    spec = F.when((F.col("kind") == "purchase") & (F.col("kmh") > 300), 1).when((F.col("kind") == "click") & (F.col("kmh") > 300), 2).otherwise(3)
    return first_spec(VIEWS["v_pass"](spark, d).select("edge_id", spec.alias("spec")), ["edge_id"]).groupBy("edge_id", "spec").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH RECURSIVE c AS MATERIALIZED (SELECT trip, seq, j, seq * 500.0::DOUBLE + stop * 10.0::DOUBLE + m AS pos, abs(m) AS cost FROM v_stop_time, (VALUES (1, -300.0::DOUBLE), (2, 0.0::DOUBLE), (3, 250.0::DOUBLE)) s(j, m)), "
    "best(trip, seq, j, pos, total, path) AS (SELECT trip, seq, j, pos, cost, [pos] FROM c WHERE seq = 1 UNION ALL SELECT n.trip, n.seq, n.j, n.pos, n.pos - b.pos + b.total + n.cost, list_append(b.path, n.pos) FROM best b JOIN c n ON n.trip = b.trip AND n.seq = b.seq + 1 AND n.pos >= b.pos "
    "QUALIFY row_number() OVER (PARTITION BY n.trip, n.seq, n.j ORDER BY n.pos - b.pos + b.total, b.j) = 1), "
    "ends AS (SELECT trip, path FROM best QUALIFY row_number() OVER (PARTITION BY trip ORDER BY seq DESC, total, j) = 1) SELECT trip, CAST(k AS INTEGER) AS seq, path[k] AS position FROM ends, unnest(range(1, len(path) + 1)) AS t(k)"
)
def stops_along_shape(spark: SparkSession, d: str) -> DataFrame:
    """Each trip's stops placed along its shape in order, at least cost."""
    s = VIEWS["v_stop_time"](spark, d)
    shift = F.array(F.lit(-300.0), F.lit(0.0), F.lit(250.0))
    choices = F.transform(shift, lambda m: F.struct((F.col("seq") * 500.0 + F.col("stop") * 10.0 + m).alias("position"), F.abs(m).alias("cost")))
    return viterbi(s.select("trip", "seq", choices.alias("choices")), "trip")


@query("WITH RECURSIVE back(start, node, path, hops) AS (SELECT p_partkey, p_partkey, CAST(p_partkey AS VARCHAR), 1 FROM part UNION ALL SELECT start, node // 2, path || '>' || (node // 2), hops + 1 FROM back WHERE node > 1) SELECT start, path, hops FROM back WHERE node <= 1")
def path_back_trace(spark: SparkSession, d: str) -> DataFrame:
    """Paths of parts to the root of a tree of keys."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("prev"))
    out = back_trace(p)
    return out.select("start", F.array_join("path", ">").alias("path"), F.size("path").alias("hops"))


@query("SELECT zone, h AS hour, round(w * CASE WHEN h BETWEEN 6 AND 9 THEN 0.1 WHEN h BETWEEN 15 AND 18 THEN 0.09 ELSE 0.015 END, 6) AS flow FROM (SELECT zone, sum(places) AS w FROM v_service GROUP BY 1), (SELECT unnest(range(0, 24)) AS h)")
def gateway_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flow of each gateway and hour from a daily profile."""
    h = F.col("hour")
    share = F.when(h.between(6, 9), 0.1).when(h.between(15, 18), 0.09).otherwise(0.015)
    z = VIEWS["v_service"](spark, d).groupBy("zone").agg(F.sum("places").alias("w")).withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    return z.select("zone", "hour", F.round(F.col("w") * share, 6).alias("flow"))


def _step(minute: int, before: str) -> str:
    """SQL of the lots started in a minute, on what is free after the steps before."""
    draw = "(({0}) * 7919 + " + str(minute * 104729) + ") % 10007 / 10007.0::DOUBLE"
    return (
        f"SELECT {minute}::BIGINT AS minute, zone, id FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY {draw.format('id')} * (1 + id % 7 / 3.0::DOUBLE) * (0.5 + residents / 10000) DESC, id) AS k, count(*) OVER (PARTITION BY zone) * 0.02 * (0.5 + zone % 4 / 2.0::DOUBLE) AS e "
        f"FROM v_home WHERE id NOT IN (SELECT id FROM ({before}))) WHERE k <= CASE WHEN zone % 4 > 0 THEN greatest(1, floor(e) + CASE WHEN {draw.format('zone')} < e - floor(e) THEN 1 ELSE 0 END) ELSE floor(e) + CASE WHEN {draw.format('zone')} < e - floor(e) THEN 1 ELSE 0 END END"
    )


@query(
    f"WITH a AS MATERIALIZED ({_step(1, 'SELECT -1 AS id')}), b AS MATERIALIZED ({_step(2, 'SELECT id FROM a')}), c AS MATERIALIZED ({_step(3, 'SELECT id FROM a UNION ALL SELECT id FROM b')}) "
    "SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"
)
def growth_quota(spark: SparkSession, d: str) -> DataFrame:
    """The lots on which building starts in each of three minutes, by zone quotas in weighted order."""
    lots = VIEWS["v_home"](spark, d).select("id", "zone", (F.col("id") % 7).alias("context"), (0.5 + F.col("residents") / 10_000).alias("dear"), (0.5 + F.col("zone") % 4 / 2.0).alias("rate"))
    return grown(lots, [1, 2, 3])


@query("SELECT o_custkey AS id, count(*) AS orders, CASE WHEN max(t) >= 400000 THEN 'metropolis' WHEN max(t) >= 250000 THEN 'city' WHEN max(t) >= 100000 THEN 'town' ELSE 'village' END AS stage FROM (SELECT o_custkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS t FROM orders) GROUP BY 1")
def career_stage(spark: SparkSession, d: str) -> DataFrame:
    """The furthest stage whose goal each account's running total has met."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, d, "orders").select("o_custkey", F.sum("o_totalprice").over(w).alias("t")).groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("orders"), F.max("t").alias("t"))
    stage = F.when(F.col("t") >= 400_000, "metropolis").when(F.col("t") >= 250_000, "city").when(F.col("t") >= 100_000, "town").otherwise("village")
    return t.select("id", "orders", stage.alias("stage"))


@query("SELECT edge_id, CAST(min(t) AS INTEGER) AS limit_t FROM (SELECT l_partkey AS edge_id, CASE WHEN l_quantity < 10 THEN 8 WHEN l_quantity < 30 THEN 20 ELSE 40 END AS t FROM lineitem) GROUP BY 1")
def weight_limits(spark: SparkSession, d: str) -> DataFrame:
    """The least weight limit over an edge's ways."""
    t = F.when(F.col("l_quantity") < 10, 8).when(F.col("l_quantity") < 30, 20).otherwise(40)
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("edge_id")).agg(F.min(t).alias("limit_t"))


@query("SELECT a.o_zone, a.d_zone, round(a.trips - b.trips, 4) AS imbalance FROM v_od a JOIN v_od b ON a.o_zone = b.d_zone AND a.d_zone = b.o_zone WHERE a.o_zone < a.d_zone")
def od_imbalance(spark: SparkSession, d: str) -> DataFrame:
    """Trips there less trips back of each pair of zones."""
    od = VIEWS["v_od"](spark, d)
    back = od.select(F.col("d_zone").alias("o_zone"), F.col("o_zone").alias("d_zone"), F.col("trips").alias("back"))
    return od.join(back, ["o_zone", "d_zone"]).where("o_zone < d_zone").select("o_zone", "d_zone", F.round(F.col("trips") - F.col("back"), 4).alias("imbalance"))


_N = GRS80_F / (2 - GRS80_F)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_RADIUS = 0.9999 * GRS80_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


@query(
    f"WITH p AS (SELECT id, north / {_RADIUS!r}::DOUBLE AS u, (east - 500000) / {_RADIUS!r}::DOUBLE AS v FROM ({PROJECTED})), "
    "q AS (SELECT id, u - " + " - ".join(f"{b!r}::DOUBLE * sin({2 * j} * u) * cosh({2 * j} * v)" for j, b in enumerate(_BETA, 1)) + " AS u, v - " + " - ".join(f"{b!r}::DOUBLE * cos({2 * j} * u) * sinh({2 * j} * v)" for j, b in enumerate(_BETA, 1)) + " AS v FROM p), "
    "c AS (SELECT id, asin(sin(u) / cosh(v)) AS chi, atan2(sinh(v), cos(u)) AS off FROM q) SELECT id, round(degrees(chi + " + " + ".join(f"{c!r}::DOUBLE * sin({2 * j} * chi)" for j, c in enumerate(_DELTA, 1)) + "), 8) AS lat, round(16.5 + degrees(off), 8) AS lon FROM c"
)
def scene_to_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degrees to easting and northing, and back to degrees."""
    p = VIEWS["v_point"](spark, d)
    lon, lat = degrees_of(*transverse_mercator(16 + F.col("x") / 77_600.0, 45.8 + F.col("z") / 111_320.0))
    return p.select("id", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


_BOXES = "SELECT id, x, z, 100.0 + 20 * kind AS w, 80.0 + id % 50 AS h FROM v_point"
_LAP = "greatest(least(a.x + a.w / 2, b.x + b.w / 2) - greatest(a.x - a.w / 2, b.x - b.w / 2), 0) * greatest(least(a.z + a.h / 2, b.z + b.h / 2) - greatest(a.z - a.h / 2, b.z - b.h / 2), 0)"


@query(f"SELECT a.id AS a, b.id AS b FROM ({_BOXES}) a JOIN ({_BOXES}) b ON a.id < b.id AND {_LAP} >= 0.3 * least(a.w * a.h, b.w * b.h)")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of rectangles that share three tenths of the smaller one: cells first, then the areas."""
    boxes = VIEWS["v_point"](spark, d).select("id", "x", "z", (100.0 + 20 * F.col("kind")).alias("w"), (80.0 + F.col("id") % 50).alias("h"))

    def shared(c: str, size: str):
        low = F.greatest(F.col(f"l_{c}") - F.col(f"l_{size}") / 2, F.col(f"r_{c}") - F.col(f"r_{size}") / 2)
        return F.greatest(F.least(F.col(f"l_{c}") + F.col(f"l_{size}") / 2, F.col(f"r_{c}") + F.col(f"r_{size}") / 2) - low, F.lit(0.0))

    pairs = within(boxes, boxes, 320.0).where("l_id < r_id")  # no rectangle's diagonal is longer
    return pairs.where(shared("x", "w") * shared("z", "h") >= 0.3 * F.least(F.col("l_w") * F.col("l_h"), F.col("r_w") * F.col("r_h"))).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


@query("SELECT edge_id, k, round((k * 25.0 + 12.5)::DOUBLE, 4) AS at FROM (SELECT edge_id, unnest(range(0, CAST(floor(length / 25.0) AS BIGINT))) AS k FROM v_edge)")
def lots_along_edges(spark: SparkSession, d: str) -> DataFrame:
    """Lots of 25 m frontage along every edge, at their middles."""
    e = VIEWS["v_edge"](spark, d).withColumn("n", F.floor(F.col("length") / 25.0)).where("n > 0")
    lots = e.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return lots.select("edge_id", "k", F.round(F.col("k") * 25.0 + 12.5, 4).alias("at"))


@query("SELECT src, dst, CASE WHEN a_in AND b_in THEN 'inside' WHEN b_in THEN 'in' ELSE 'out' END AS way FROM (SELECT src, dst, (a.x BETWEEN 1000 AND 3000 AND a.z BETWEEN 1000 AND 3000) AS a_in, (b.x BETWEEN 1000 AND 3000 AND b.z BETWEEN 1000 AND 3000) AS b_in FROM v_arc JOIN v_zone a ON a.zone = src JOIN v_zone b ON b.zone = dst) WHERE a_in OR b_in")
def roads_across_area(spark: SparkSession, d: str) -> DataFrame:
    """Arcs into, out of and inside an area."""
    inside = F.col("x").between(1000, 3000) & F.col("z").between(1000, 3000)
    z = VIEWS["v_zone"](spark, d).select("zone", inside.alias("inside"))
    arcs = VIEWS["v_arc"](spark, d).join(z.select(F.col("zone").alias("src"), F.col("inside").alias("a_in")), "src").join(z.select(F.col("zone").alias("dst"), F.col("inside").alias("b_in")), "dst")
    way = F.when(F.col("a_in") & F.col("b_in"), "inside").when(F.col("b_in"), "in").otherwise("out")
    return arcs.where("a_in or b_in").select("src", "dst", way.alias("way"))


@query("SELECT doc_id, lang, CAST(n_chars AS BIGINT) AS size FROM documents")
def edit_list_codec(spark: SparkSession, d: str) -> DataFrame:
    """Records through their JSON form and back."""
    record = F.to_json(F.struct("doc_id", "lang", F.col("n_chars").alias("size")))
    back = F.from_json(record, "doc_id long, lang string, size long")
    return table(spark, d, "documents").select(back.alias("r")).select("r.*")
