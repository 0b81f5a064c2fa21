"""Formulas, rules and texts on small exact cases."""

import math

import pytest
from pyspark.sql import functions as F

from urbanspark.functions import formulas, rules, text
from urbanspark.operators import aggregates, graph, sequences, spatial
from urbanspark.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_geh_and_change(spark):
    lit = F.lit
    r = one(spark, a=formulas.geh(lit(100.0), lit(100.0)), b=formulas.geh(lit(150.0), lit(100.0)), c=formulas.geh(lit(0.0), lit(0.0)), d=formulas.relative_change(lit(1200.0), lit(900.0)), e=formulas.relative_change(lit(0.0), lit(0.0)))
    assert (r.a, r.c, r.d, r.e) == (0, 0, -0.25, 0)
    assert r.b == pytest.approx(math.sqrt(2 * 50**2 / 250))


def test_weighted_mean_skips_missing(spark):
    df = spark.createDataFrame([(254 / 254, 100.0), (0.5, 300.0), (None, 50.0)], "r double, l double")
    assert df.select(aggregates.weighted_mean(F.col("r"), F.col("l")).alias("m")).first().m == pytest.approx((100 + 150) / 400)
    assert df.where("r is null").select(aggregates.weighted_mean(F.col("r"), F.col("l")).alias("m")).first().m is None


def test_bands(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (0.45,), (0.2,), (0.19,), (None,)], "s double")
    assert [r[0] for r in df.select(rules.speed_band(F.col("s"))).collect()] == ["flowing", "slow", "slow", "congested", "jammed", "none"]


def test_clock_and_numbers(spark):
    r = one(spark, a=text.clock_seconds(F.lit("07:05:30")), b=text.clock_seconds(F.lit("25:10:00")), c=text.metres(F.lit("12,5")), d=text.metres(F.lit("wide")), e=text.tonnes(F.lit("7.5 t")), f=text.tonnes(F.lit("7.5 tonnes")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (25_530, 90_600, 12.5, None, 7.5, None)


def test_fold(spark):
    r = one(spark, a=text.fold(F.lit("Šibenik – Đakovo, ČĆ!")), b=text.holds_words(F.lit("Nova Cesta Zapad"), F.lit("cesta nova")), c=text.road_refs(F.lit("d 1; E59;x")))
    assert (r.a, r.b, r.c) == ("sibenik dakovo cc", True, ["D1", "E59"])


def test_daily_window_past_midnight(spark):
    df = spark.createDataFrame([(79_200,), (100,), (21_600,), (50_000,)], "t int")
    assert [r[0] for r in df.select(formulas.in_daily_window(F.col("t"), F.lit(79_200), F.lit(21_600))).collect()] == [True, True, False, False]


def test_kernel(spark):
    src = spark.createDataFrame([(1, 0.0, 0.0, 90.0)], "id long, x double, z double, w double")
    sinks = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 1000.0, 0.0)], "id long, x double, z double")
    got = {r.r_id: round(r.value, 2) for r in spatial.kernel_allocation(src, sinks, 400.0).collect()}
    assert got == {1: 51.43, 2: 38.57}


def test_catchment(spark):
    homes = spark.createDataFrame([(1, 0.0, 0.0, 100.0), (2, 5000.0, 0.0, 100.0)], "id long, x double, z double, residents double")
    services = spark.createDataFrame([(1, 100.0, 0.0, 50.0)], "id long, x double, z double, places double")
    assert {r.id: r.supply for r in spatial.catchment(services, homes, 1000.0).collect()} == {1: 0.5, 2: 0.0}


def test_within_has_no_theta_join(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, z double")
    plan = spatial.within(p, p, 10.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_deltas_and_reset(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 2, 15), (1, 3, 4)], "k int, t int, c int")
    assert [r.delta for r in sequences.counter_deltas(df, ["k"], ["t"], "c").orderBy("t").collect()] == [10, 5, 4]


def test_thin_and_fill(spark):
    df = spark.createDataFrame([(1, i * 600) for i in range(10)], "k int, t long")
    assert sequences.thin(df, ["k"], ["t"], F.lit(4)).count() == 4
    assert sequences.fill_gaps(df, ["k"], "t", 1, 7200, []).count() == 19


def test_delta_codec(spark):
    df = spark.createDataFrame([(1, 1, 105.0), (1, 2, 104.37), (2, 1, -3.5)], "k int, i int, x double")
    back = tables.unpack_deltas(tables.pack_deltas(df, ["k"], "i", "x"), ["k"], "i")
    assert all(abs(r.value - r.x) < 0.005 for r in back.collect())
    far = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1e4), (1, 3, -1e4), (1, 4, 2.0)], "k int, i int, x double")
    packed = tables.pack_deltas(far, ["k"], "i", "x")
    assert packed.where("i > 1 and abs(step) > 32767").count() == 0 and packed.count() > far.count()
    assert {(r.i, round(r.value, 2)) for r in tables.unpack_deltas(packed, ["k"], "i").collect()} == {(1, 5.0), (2, 1e4), (3, -1e4), (4, 2.0)}


def test_reach_both_ways(spark):
    arcs = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (1, 3, 20.0), (3, 1, 1.0)], "src long, dst long, cost double")
    sources = spark.createDataFrame([(1,), (3,)], "node long")
    want = {(1, 1, 0.0), (1, 2, 5.0), (1, 3, 10.0), (3, 3, 0.0), (3, 1, 1.0), (3, 2, 6.0), (3, 4, 0.0)} - {(3, 4, 0.0)}
    for f in (graph.relax,):
        assert {(r.source, r.node, r.cost) for r in f(arcs, sources, 15.0).collect()} == want


def test_fastest_paths(spark):
    arcs = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (1, 3, 20.0), (3, 1, 1.0)], "src long, dst long, cost double")
    queries = spark.createDataFrame([(1, 3), (2, 1), (1, 1), (1, 9)], "source long, target long")
    got = {(r.source, r.target): (r.cost, r.path) for r in graph.fastest_paths(arcs, queries).collect()}
    assert got == {(1, 3): (10.0, [1, 2, 3]), (2, 1): (6.0, [2, 3, 1]), (1, 1): (0.0, [1]), (1, 9): (None, None)}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8)], "a long, b long")
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(5, 2), (4, 2), (3, 2), (2, 2), (9, 8), (8, 8)}


def test_back_turn_only_without_another_way(spark):
    links = spark.createDataFrame([(1, 2, 1, 10.0, "left"), (1, 3, 2, 5.0, "back"), (4, 1, 2, 5.0, "back")], "src long, dst long, classes long, cost double, turn string")
    assert {(r.src, r.dst, r.cost) for r in graph.routing_arcs(links).collect()} == {(1, 2, 14.0), (4, 1, 65.0)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("naziv;broj\nŠuma;1\n".encode("windows-1250"))
    assert tables.read_delimited(spark, str(tmp_path / "a.csv"), "naziv string, broj int").first() == ("Šuma", 1)
    (tmp_path / "n.xml").write_text('<net><edge id="1" speed="13.9"/><edge id="2"/></net>')
    assert [tuple(r) for r in tables.read_network(spark, str(tmp_path / "n.xml"), "edge", "_id string, _speed double").orderBy("_id").collect()] == [("1", 13.9), ("2", None)]
    tables.write_layer(spark.range(5), str(tmp_path / "layer"), ["id"])
    assert spark.read.parquet(str(tmp_path / "layer")).count() == 5
