"""Grids, polygon overlaps, boundary tracing and times between fractions against plain versions and worked examples."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from urbanspark.operators import grids as G
from urbanspark.operators import journeys as J
from urbanspark.operators import polygons as P
from urbanspark.operators import sequences

C = 1500.0


def value_at(spark, cells, x, z):
    points = spark.createDataFrame([(1, x * C, z * C)], "id int, x double, z double")
    return G.between_cells(points, cells, C).first().value


def test_accessibility_between_centres(spark):
    lots = spark.createDataFrame([(0, 0.1 * C, 0.1 * C, 0), (1, 0.45 * C, 0.5 * C, 1), (2, 1.5 * C, 0.5 * C, 2), (3, 9.5 * C, 0.5 * C, None)], "lot int, x double, z double, edge int")
    sources = G.cell_sources(lots, C)
    assert {(r.cx, r.cz): r.edge for r in sources.collect()} == {(0, 0): 1, (1, 0): 2}
    empty = spark.createDataFrame([], "cx long, cz long, value double")
    first = sources.select("cx", "cz", F.when(F.col("edge") == 1, 1000.0).otherwise(200.0).alias("value"))
    cells = G.blended(empty, first)
    assert value_at(spark, empty, 0.5, 0.5) is None
    for x, want in ((0.5, 1000), (1.5, 200), (1.0, 600), (1.9, 200)):
        assert value_at(spark, cells, x, 0.5) == pytest.approx(want)
    again = G.blended(cells, first.withColumn("value", 3 * F.col("value")))
    assert value_at(spark, again, 0.5, 0.5) == pytest.approx(2000)
    assert value_at(spark, G.blended(again, first.withColumn("value", F.lit(float("nan")))), 0.5, 0.5) == pytest.approx(2000)


def test_land_value(spark):
    row = spark.range(1)
    value = lambda *args: row.select(G.land_value(*map(F.lit, args))).first()[0]
    assert value(10_000.0, 10_000.0, 0.0, 0.0, 0.0, 0.0) == pytest.approx(100)
    assert value(1_000.0, 10_000.0, 0.0, 0.0, 0.0, 0.0) == pytest.approx(100 * 0.1**0.75)
    assert value(10_000.0, 10_000.0, 100.0, 0.0, 0.0, 0.0) == pytest.approx(110)


@pytest.mark.parametrize("tile", [3, 256])
def test_box_sums(spark, tile):
    rng = random.Random(tile)
    n = {(rng.randint(-9, 14), rng.randint(-5, 11)): rng.randint(1, 9) for _ in range(60)}
    out = G.box_sums(spark.createDataFrame([(x, z, v) for (x, z), v in n.items()], "cx long, cz long, v long"), 2, tile).collect()
    xs, zs = [x for x, _ in n], [z for _, z in n]
    want = {(x, z): sum(v for (a, b), v in n.items() if abs(a - x) <= 2 and abs(b - z) <= 2) for x in range(min(xs), max(xs) + 1) for z in range(min(zs), max(zs) + 1)}
    assert {(r.cx, r.cz): r.v for r in out} == want and len(out) == len(want)
    assert G.box_sums(spark.createDataFrame([], "cx long, cz long, v long"), 1).count() == 0


def test_smoothed_by_buckets(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), t, rng.uniform(0, 90)) for t in range(300)] + [("one", 5, 7.0)]
    got = {r.k: r.smoothed for r in G.smoothed(spark.createDataFrame(rows, "k string, t int, v double"), "k", ["t"], F.floor(F.col("t") / 7), "v", 0.2).collect()}
    for k in ("a", "b", "one"):
        values = [v for key, _, v in rows if key == k]
        s = values[0]
        for v in values[1:]:
            s = 0.8 * s + 0.2 * v
        assert got[k] == pytest.approx(s)


@pytest.mark.parametrize("ahead", [False, True])
def test_rows_beside_each_other_over_buckets(spark, ahead):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), t * rng.choice([1, 1, 40]), t) for t in range(200)]
    out = sequences.beside(spark.createDataFrame(rows, "k string, t int, v int"), ["k"], ["t", "v"], F.floor(F.col("t") / 50), ["v"], ahead).collect()
    want = []
    for k in ("a", "b", None):
        mine = sorted((t, v) for key, t, v in rows if key == k)
        values = [v for _, v in mine]
        others = [*values[1:], None] if ahead else [None, *values[:-1]]
        want += [(k, t, v, o) for (t, v), o in zip(mine, others, strict=True)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def clip(a, b):
    """Area of a within convex b, by cutting a along each side of b."""
    for (px, pz), (qx, qz) in zip(b, b[1:] + b[:1], strict=True):
        side = lambda p: (qx - px) * (p[1] - pz) - (qz - pz) * (p[0] - px)  # noqa: B023, E731
        out = []
        for s, e in zip(a, a[1:] + a[:1], strict=True):
            if side(s) >= 0:
                out.append(s)
            if (side(s) > 0) != (side(e) > 0) and side(s) != side(e):
                t = side(s) / (side(s) - side(e))
                out.append((s[0] + t * (e[0] - s[0]), s[1] + t * (e[1] - s[1])))
        a = out
        if not a:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(a, a[1:] + a[:1], strict=True))) / 2


def test_overlaps_against_clipping(spark):
    rng = random.Random(7)
    rings = []
    for i in range(60):
        x, z, r, n, start = rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(10, 60), rng.randint(3, 7), rng.random()
        rings.append((i, [(x + r * math.cos(start + 2 * math.pi * k / n), z + r * math.sin(start + 2 * math.pi * k / n)) for k in range(n)]))
    rings += [(60, [(0, 0), (10, 0), (10, 10), (0, 10)]), (61, [(0, 0), (10, 0), (10, 10), (0, 10)]), (62, [(10, 0), (20, 0), (20, 10), (10, 10)]), (63, [(2, 0), (8, 0), (8, 4), (2, 4)])]
    left = [ring[::-1] if i % 3 == 0 else ring for i, ring in rings]
    df = spark.createDataFrame([(i, [{"x": float(x), "z": float(z)} for x, z in ring]) for (i, _), ring in zip(rings, left, strict=True)], "id int, ring array<struct<x double, z double>>")
    got = {(r.a, r.b): r.shared for r in P.overlaps(df, df, 25.0).collect() if r.a < r.b}
    want = {(i, j): area for i, a in rings for j, b in rings if i < j and (area := clip(a, b)) > 1e-9}
    assert {k: v for k, v in got.items() if v > 1e-9} == pytest.approx(want)
    assert got[60, 61] == 100 and got[60, 63] == 24 and (60, 62) not in got


def ring_frame(spark, rings):
    return spark.createDataFrame([(i, [{"x": float(x), "z": float(z)} for x, z in ring]) for i, ring in rings], "id int, ring array<struct<x double, z double>>")


def test_overlaps_of_a_crowd(spark, monkeypatch):
    """Every pair of a crowded cell meets in its pieces; 60,000 of them are cut in far less than a minute."""
    monkeypatch.setattr(P, "PIECE", 50)
    rng = random.Random(9)
    rings = []
    for i in range(350):
        x, z, r, n, start = rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(30, 60), rng.randint(3, 5), rng.random()
        rings.append((i, [(x + r * math.cos(start + 2 * math.pi * k / n), z + r * math.sin(start + 2 * math.pi * k / n)) for k in range(n)]))
    df = ring_frame(spark, rings)
    began = time.monotonic()
    got = {(r.a, r.b): r.shared for r in P.overlaps(df, df, 200.0, once=True).collect()}
    assert time.monotonic() - began < 60
    want = {(i, j): area for i, a in rings for j, b in rings if i < j and (area := clip(a, b)) > 1e-9}
    assert {k: v for k, v in got.items() if v > 1e-9} == pytest.approx(want)


def test_rings_without_an_area_share_none(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    odd = [(2, [(0, 0), (math.inf, 0), (math.inf, 10), (0, 10)]), (3, [(math.nan, 0), (10, 0), (10, 10), (0, 10)]), (4, []), (5, [(1, 1)]), (6, [(1, 1), (5, 5)])]
    df = ring_frame(spark, [(0, square), (1, square[::-1]), *odd]).union(spark.createDataFrame([(7, None)], "id int, ring array<struct<x double, z double>>"))
    assert [(r.a, r.b, r.shared) for r in P.overlaps(df, df, 25.0, once=True).collect()] == [(0, 1, 100)]


def streets(spark, lines):
    rows = [(k, [{"x": float(x), "z": float(z)} for x, z in line]) for k, line in lines]
    return spark.createDataFrame(rows, "ord int, points array<struct<x double, z double>>")


def test_zone_follows_its_streets(spark):
    lines = [(0, [(-100, 0), (0, 0), (1000, 0), (1100, 0)]), (1, [(1000, -100), (1000, 0), (1000, 500)]), (1, [(1000, 500), (1000, 1000), (1000, 1100)]), (2, [(1100, 1000), (1000, 1000), (0, 1000), (-100, 1000)]), (3, [(0, 1100), (0, 1000), (0, 0), (0, -100)])]
    ring = [(r.x, r.z) for r in J.traced_boundary(streets(spark, lines)).orderBy("seq").collect()]
    assert set(ring) == {(0, 0), (1000, 0), (1000, 500), (1000, 1000), (0, 1000)} and len(ring) == 5
    assert abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 == 1e6
    apart = [*lines[:2], (1, [(1000, 600), (1000, 1000)]), *lines[3:]]
    assert {(r.x, r.z) for r in J.traced_boundary(streets(spark, apart)).collect()} == {(0, 0), (1000, 0), (1000, 1000), (0, 1000)}


def test_no_zone_without_enough_streets(spark):
    assert J.traced_boundary(streets(spark, [(0, [(0, 0), (1, 1)]), (1, [(1, 1), (2, 2)])])).count() == 0


def test_times_between_fractions(spark):
    edges = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "edge int, time double")
    links = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 1, 3.0), (1, 3, 99.0)], "a int, b int, via double")
    pairs = spark.createDataFrame([(0, 1, 0.5, 3, 0.5), (1, 2, 0.2, 2, 0.7), (2, 2, 0.7, 2, 0.2), (3, 3, 0.0, 2, 0.0), (4, 2, 0.5, 2, 0.5)], "id int, a int, fa double, b int, fb double")
    got = {r.id: r.seconds for r in J.between_fractions(pairs, edges, links).collect()}
    assert got == pytest.approx({0: 5 + 1 + 20 + 2 + 15, 1: 10.0, 2: 6 + 2 + 30 + 3 + 10 + 1 + 4, 3: 30 + 3 + 10 + 1, 4: 0.0})
    assert J.between_fractions(pairs, edges, links.where("a <> 3")).where("id = 3").first().seconds is None
