"""Names, numbers, tags and rules in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanspark.functions.rules import CLASSES, first_rule, permission_mask, valid_at, wanted_way
from urbanspark.functions.text import clock_seconds, cluster_id, fold, junction_of, lat_lon_points, metres, normal_name, road_refs, shape_points, street_key, title_case, tonnes, word_set
from urbanspark.registry import query
from urbanspark.sources.tables import latest, pack_deltas, terrain_height, unpack_deltas
from urbanspark.sources.views import VIEWS, table

_FOLD = "trim(regexp_replace(replace(replace(strip_accents(lower({c})), 'ß', 'ss'), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))"


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS name, " + _FOLD.format(c="p_name") + " AS folded FROM part")
def fold_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), normal_name(F.col("p_name")).alias("name"), fold(F.col("p_name")).alias("folded"))


@query("SELECT doc_id, " + _FOLD.format(c="text") + " AS folded FROM documents")
def fold_documents(spark: SparkSession, d: str) -> DataFrame:
    """Accents and punctuation folded over whole documents."""
    return table(spark, d, "documents").select("doc_id", fold(F.col("text")).alias("folded"))


@query("SELECT s_suppkey AS id, array_to_string(list_sort(list_distinct(list_filter(string_split(" + _FOLD.format(c="s_name") + ", ' '), lambda w: w <> ''))), ' ') AS words, replace(replace(' ' || " + _FOLD.format(c="s_name") + " || ' ', ' the ', ' '), ' ', '') AS street FROM supplier")
def word_sets(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of names, and the key without stop words."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(word_set(F.col("s_name")), " ").alias("words"), street_key(F.col("s_name"), ("the",)).alias("street"))


@query("SELECT p_partkey AS id, TRY_CAST(replace(nullif(regexp_extract(s, '^\\s*([0-9]+([.,][0-9]+)?)', 1), ''), ',', '.') AS DOUBLE) AS metres, TRY_CAST(replace(nullif(regexp_extract(t, '^\\s*([0-9]+([.,][0-9]+)?)\\s*t?\\s*$', 1), ''), ',', '.') AS DOUBLE) AS tonnes FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || ' m' WHEN 1 THEN p_size || ',5' ELSE 'none' END AS s, CASE p_partkey % 3 WHEN 0 THEN p_size || '.5 t' WHEN 1 THEN p_size || ' tonnes' ELSE CAST(p_size AS VARCHAR) END AS t FROM part)")
def parse_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and weights as people write them."""
    p, size = table(spark, d, "part"), F.col("p_size").cast("string")
    k = F.col("p_partkey") % 3
    s = F.when(k == 0, F.concat(size, F.lit(" m"))).when(k == 1, F.concat(size, F.lit(",5"))).otherwise("none")
    t = F.when(k == 0, F.concat(size, F.lit(".5 t"))).when(k == 1, F.concat(size, F.lit(" tonnes"))).otherwise(size)
    return p.select(F.col("p_partkey").alias("id"), metres(s).alias("metres"), tonnes(t).alias("tonnes"))


@query("SELECT o_orderkey AS id, CAST(o_orderkey % 30 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 7 AS INTEGER) AS seconds FROM orders")
def parse_clock(spark: SparkSession, d: str) -> DataFrame:
    """Times past 24 hours, parsed from their text."""
    k = F.col("o_orderkey")
    text = F.format_string("%02d:%02d:%02d", k % 30, k % 60, k % 7)
    return table(spark, d, "orders").select(k.alias("id"), clock_seconds(text).cast("int").alias("seconds"))


@query("SELECT p_partkey AS id, 'D' || p_size || ',E' || (p_size + 40) AS refs, CAST(p_size + 0.5 AS DOUBLE) AS x, CAST(2 AS INTEGER) AS n FROM part")
def parse_refs_and_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Road numbers and shapes from their texts."""
    size = F.col("p_size").cast("string")
    refs = road_refs(F.concat(F.lit("d "), size, F.lit("; e"), (F.col("p_size") + 40).cast("string"), F.lit(";xx")))
    points = shape_points(F.concat(size, F.lit(".5,1 2,"), size))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(refs, ",").alias("refs"), points[0]["x"].alias("x"), F.size(points).alias("n"))


@query("SELECT o_custkey AS id, array_to_string(list_sort(list(o_orderkey)), '_') AS cluster FROM orders GROUP BY 1")
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    """An id from the sorted members of each group."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(cluster_id(F.collect_list("o_orderkey")).alias("cluster"))


@query("SELECT p_partkey AS id, CASE WHEN contains(p_type, 'ECONOMY') THEN 'housing' WHEN contains(p_type, 'STANDARD') THEN 'mixed' WHEN contains(p_type, 'PROMO') THEN 'shops' ELSE 'other' END AS land FROM part")
def planned_use(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that a plan's name meets."""
    rules = [("ECONOMY", "housing"), ("STANDARD", "mixed"), ("PROMO", "shops")]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), first_rule(F.col("p_type"), rules, "other").alias("land"))


_FINE = [(fine, bit) for bit, members in CLASSES.values() for fine in members]


@query(
    "WITH fine(k, name, bit) AS (VALUES " + ", ".join(f"({k}, '{fine}', {bit})" for k, (fine, bit) in enumerate(_FINE)) + ") "
    "SELECT p_partkey AS id, CAST(coalesce(bit_or(bit) FILTER (CASE p_size % 3 WHEN 0 THEN (p_partkey >> (k % 9)) & 1 = 1 WHEN 1 THEN (p_partkey >> (k % 9)) & 1 = 0 ELSE true END), 0) AS INTEGER) AS allowed FROM part, fine GROUP BY 1"
)
def permission_masks(spark: SparkSession, d: str) -> DataFrame:
    """Class bits of lanes with a list of who may use them, of who may not, or none."""
    listed = F.array(*(F.when(F.col("p_partkey").bitwiseAND(1 << k % 9) != 0, fine) for k, (fine, _) in enumerate(_FINE)))
    names = F.array_join(F.array_compact(listed), " ")
    lists = [F.when(F.col("p_size") % 3 == kind, names) for kind in (0, 1)]
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), permission_mask(*lists).alias("allowed"))


@query("SELECT o_orderkey AS id FROM orders WHERE (o_orderstatus = 'O' OR o_orderdate <= TIMESTAMP '1995-06-01') AND (o_orderstatus = 'F' OR TIMESTAMP '1995-06-01' <= o_orderdate + INTERVAL 90 DAY)")
def valid_closures(spark: SparkSession, d: str) -> DataFrame:
    """Intervals with open ends that hold a moment."""
    now = F.expr("timestamp_ntz '1995-06-01 00:00:00'")
    start = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    end = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate") + F.expr("interval 90 days"))
    return table(spark, d, "orders").where(valid_at(start, end, now)).select(F.col("o_orderkey").alias("id"))


@query("SELECT vehicle AS id, arg_max(kind, row(ts, pass_id)) AS state FROM v_pass GROUP BY 1")
def latest_layer(spark: SparkSession, d: str) -> DataFrame:
    """Catalog upsert: the newest entry of each layer."""
    p = VIEWS["v_pass"](spark, d).withColumn("v", F.struct("ts", "pass_id"))
    return latest(p, ["vehicle"], "v").select(F.col("vehicle").alias("id"), F.col("kind").alias("state"))


@query("SELECT id, kind, round(x * 100) / 100 AS x FROM v_point")
def delta_codec(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates through whole steps and back."""
    blocks = VIEWS["v_point"](spark, d).withColumn("block", F.floor(F.col("id") / 4096))  # each begins with its own first value
    packed = pack_deltas(blocks, ["kind", "block"], "id", "x")
    return unpack_deltas(packed.select("id", "kind", "block", "step", "part", "parts"), ["kind", "block"], "id").select("id", "kind", F.round("value", 2).alias("x"))


@query("SELECT p_partkey AS id, round(((p_partkey % 3) * 65536 + (p_size * 5) * 256 + p_partkey % 256) * 0.1::DOUBLE - 10000, 4) AS height FROM part")
def terrain_heights(spark: SparkSession, d: str) -> DataFrame:
    h = terrain_height(F.col("p_partkey") % 3, F.col("p_size") * 5, F.col("p_partkey") % 256)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(h, 4).alias("height"))


@query("SELECT doc_id, kind, place FROM (SELECT doc_id, kind, row_number() OVER (ORDER BY kind, doc_id) AS place FROM (SELECT doc_id, 1 AS kind FROM documents WHERE contains(" + _FOLD.format(c="text") + ", 'the of') UNION ALL SELECT page_id, 2 FROM pages WHERE contains(" + _FOLD.format(c="html") + ", 'the of'))) WHERE place <= 20")
def search_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 documents and pages that hold a phrase, documents first."""
    has = lambda t, key, c, kind: table(spark, d, t).where(fold(F.col(c)).contains("the of")).select(F.col(key).alias("doc_id"), F.lit(kind).alias("kind"))
    first = has("documents", "doc_id", "text", 1).union(has("pages", "page_id", "html", 2)).orderBy("kind", "doc_id").limit(20)
    return first.withColumn("place", F.row_number().over(Window.orderBy("kind", "doc_id")).cast("long"))  # 20 rows


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Osnovna škola Ivana Kovačića' WHEN 1 THEN 'IV. Gimnazija na Brdu' WHEN 2 THEN '(OŠ) Novi-Grad' ELSE 'Old Town' END AS name FROM customer")
def title_names(spark: SparkSession, d: str) -> DataFrame:
    """Names written in capitals, as people write them."""
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, "OSNOVNA ŠKOLA IVANA KOVAČIĆA").when(k == 1, "IV. GIMNAZIJA NA BRDU").when(k == 2, "(OŠ) NOVI-GRAD").otherwise("Old Town")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), title_case(name).alias("name"))


@query("SELECT p_partkey AS id, 2 AS n, CAST(45 + p_size / 100.0 AS DOUBLE) AS lat, CAST(p_size AS DOUBLE) AS lon, 'j_' || p_size AS junction FROM part")
def polylines_and_junctions(spark: SparkSession, d: str) -> DataFrame:
    """Points of 'lat lon lat lon' texts, and junctions of internal edges."""
    size = F.col("p_size").cast("string")
    points = lat_lon_points(F.concat((45 + F.col("p_size") / 100.0).cast("string"), F.lit("  "), size, F.lit(" 1 2 3")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(points).alias("n"), points[0]["lat"].alias("lat"), points[0]["lon"].alias("lon"), junction_of(F.concat(F.lit(":j_"), size, F.lit("_12"))).alias("junction"))


@query("SELECT c_custkey AS id, 'New ' || lower(c_mktsegment) || ' ' || (count(*) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)) AS name FROM customer")
def next_free_names(spark: SparkSession, d: str) -> DataFrame:
    """'New label n + 1' after n of the kind in the zone."""
    before = F.count(F.lit(1)).over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("New "), F.lower("c_mktsegment"), F.lit(" "), (before + 1).cast("string")).alias("name"))


@query("SELECT p_partkey AS id FROM part WHERE (p_size % 5 IN (0, 1) AND p_size % 7 <> 0 AND NOT (p_size % 5 = 1 AND p_size % 3 = 0)) OR (p_size % 5 NOT IN (0, 1) AND p_size % 11 = 0)")
def wanted_ways(spark: SparkSession, d: str) -> DataFrame:
    """Ways by their tags: driven roads that are no areas or minor services, and tracks."""
    size = F.col("p_size")
    highway = F.when(size % 5 == 0, "primary").when(size % 5 == 1, "service").otherwise("footway")
    tags = F.map_from_arrays(
        F.array(F.lit("highway"), F.lit("area"), F.lit("service"), F.lit("railway")),
        F.array(highway, F.when(size % 7 == 0, "yes"), F.when(size % 3 == 0, "parking_aisle"), F.when(size % 11 == 0, "tram")),
    )
    return table(spark, d, "part").where(wanted_way(F.map_filter(tags, lambda _, v: v.isNotNull()))).select(F.col("p_partkey").alias("id"))
