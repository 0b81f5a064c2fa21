"""Journeys against a heap search; lines against plain geometry and worked examples."""

import heapq
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from urbanspark.operators import journeys as J
from urbanspark.operators import lines as L


def graph(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n), float(rng.choice([0, 1, 1, 2, 5, 9])), float(rng.choice([0, 1, 2, 3]))) for _ in range(m)]


def dijkstra(arcs, starts):
    best, heap = {}, [(c, p, n) for n, c, p in starts]
    heapq.heapify(heap)
    while heap:
        c, p, n = heapq.heappop(heap)
        if n not in best:
            best[n] = (c, p)
            for a, b, w, q in arcs:
                if a == n and b not in best:
                    heapq.heappush(heap, (c + w, p + q, b))
    return best


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(6)
    arcs = graph(rng, 30, 90)
    legs = [(place, rng.randrange(30), float(rng.randint(1, 9)), float(rng.randint(1, 4))) for place in range(6) for _ in range(2)]
    a = spark.createDataFrame(arcs, "src int, dst int, cost double, plain double")
    walk = spark.createDataFrame(legs, "place int, node int, cost double, plain double")
    return arcs, legs, walk, J.search(a, walk.withColumnRenamed("place", "source"))


def test_search_and_journeys(searched):
    arcs, legs, walk, labels = searched
    want = {(s, n): label for s in range(6) for n, label in dijkstra(arcs, [leg[1:] for leg in legs if leg[0] == s]).items()}
    rows = labels.collect()
    assert {(r.source, r.node): (r.cost, r.plain) for r in rows} == want
    prev = {(r.source, r.node): r.prev for r in rows}
    for (s, n), p in prev.items():
        steps = 0
        while p is not None:
            assert any(a == p and b == n and want[s, p][0] + w == want[s, n][0] and want[s, p][1] + q == want[s, n][1] for a, b, w, q in arcs)
            n, p, steps = p, prev[s, p], steps + 1
            assert steps <= 30
    ways = {(r.source, r.place): (r.cost, r.plain) for r in J.journeys(labels, walk).collect()}
    brute = {}
    for (s, n), (c, p) in want.items():
        for d, m, w, q in legs:
            if m == n and d != s:
                brute[s, d] = min(brute.get((s, d), (math.inf, 0)), (c + w, p + q))
    assert ways == brute


def test_boardings_and_paths(spark, searched):
    arcs, _, _, labels = searched
    ends = [(r.source, r.node, float(1 + r.node % 4)) for r in labels.collect() if r.node % 3 == 0]
    flows = spark.createDataFrame(ends, "source int, node int, flow double")
    paths = {(r.source, r.node): r.path for r in J.paths(labels, flows).collect()}
    assert set(paths) == {(s, n) for s, n, _ in ends} and all(p[-1] == n for (_, n), p in paths.items())
    boards = [(a, b, line, share) for a, b in {(a, b) for a, b, *_ in arcs if a % 2} for line, share in (("x", 1.0),) if b % 2] + [(a, b, line, 0.5) for a, b in {(a, b) for a, b, *_ in arcs if not a % 2} for line in "yz"]
    want = {}
    for s, n, f in ends:
        for step in zip(paths[s, n], paths[s, n][1:], strict=False):
            for a, b, line, share in boards:
                if (a, b) == step:
                    want[line] = want.get(line, 0) + f * share
    got = {r.line: r.boardings for r in J.boardings(labels, flows, spark.createDataFrame(boards, "src int, dst int, line string, share double")).collect()}
    assert got == pytest.approx(want)


POINTS = "array<struct<x double, z double>>"


def line_frame(spark, rows, columns=""):
    return spark.createDataFrame([(i, [{"x": float(x), "z": float(z)} for x, z in pts], *rest) for i, pts, *rest in rows], f"line int, points {POINTS}{columns}")


def test_round_trip_along_lines(spark):
    rng = random.Random(1)
    shapes = [(i, [(5000 * i + 130 * k + rng.uniform(-20, 20), rng.uniform(-60, 60)) for k in range(rng.randint(2, 30))]) for i in range(20)]
    shapes.append((20, [(0, 9000), (0, 9000), (0, 9800), (0, 9800)]))
    segs = L.segments(line_frame(spark, shapes))
    length = {r.line: r.n for r in segs.groupBy("line").agg(F.sum("length").alias("n")).collect()}
    at = [(100 * i + k, i, length[i] * k / 9, 0.4 if 0 < k < 9 else 0.0) for i in length for k in range(10)]
    placed = L.interpolate(spark.createDataFrame(at, "id int, line int, measure double, offset double"), segs)
    assert placed.count() == len(at)
    back = {r.id: r for r in L.project(placed.select("id", "x", "z"), segs, 40.0).collect()}
    near_corner = {r.id for r in placed.select("id", "line", "measure").join(segs.select("line", "start"), "line").where("abs(measure - start) < 1 and start > 0").collect()}
    for i, line, measure, offset in at:
        assert back[i].line == line
        if i not in near_corner:
            assert back[i].measure == pytest.approx(measure, abs=1e-6) and back[i].offset == pytest.approx(offset, abs=1e-6)


def test_interpolate_holds_to_the_ends(spark):
    segs = L.segments(line_frame(spark, [(1, [(0, 0), (0, 10), (10, 10)]), (2, [(3, 4)])]))
    at = spark.createDataFrame([(1, 1, -5.0, 0.0), (2, 1, 10.0, 2.0), (3, 1, 99.0, 0.0), (4, 2, 7.0, 1.0), (5, 9, 0.0, 0.0)], "id int, line int, measure double, offset double")
    got = {r.id: (r.x, r.z, round(r.heading, 6)) for r in L.interpolate(at, segs).collect()}
    assert got == {1: (0, 0, 0), 2: (2, 10, 0), 3: (10, 10, round(math.pi / 2, 6)), 4: (3, 4, 0)}


def test_segment_cells_hold_every_near_point(spark):
    rng = random.Random(4)
    rows = [tuple(rng.uniform(-300, 300) for _ in range(4)) for _ in range(60)] + [(5.0, -90.0, 5.0, 210.0), (-80.0, 7.0, 100.0, 7.0), (9.0, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "ax double, az double, bx double, bz double").select("*", L.segment_cells(50.0, 15.0).alias("c"))
    for r in df.collect():
        cells = {(c.cx, c.cz) for c in r.c}
        for _ in range(60):
            t, a, d = rng.random(), rng.uniform(0, 2 * math.pi), rng.uniform(0, 15)
            x, z = r.ax + t * (r.bx - r.ax) + d * math.cos(a), r.az + t * (r.bz - r.az) + d * math.sin(a)
            assert (math.floor(x / 50), math.floor(z / 50)) in cells


@pytest.mark.parametrize("street, both, want", [("Grada Vukovara", False, [0]), ("Grada Vukovara", True, [0, 1]), (None, True, [0, 1, 2]), ("", False, [0, 2]), ("Savska", True, [2])])
def test_drawn_line(spark, street, both, want):
    edges = [(0, [(0, 2), (200, 2)], "Ulica grada Vukovara"), (1, [(200, -2), (0, -2)], "Ulica grada Vukovara"), (2, [(0, 10), (200, 10)], "Savska cesta"), (3, [(0, 2), (0, 200)], "Ulica grada Vukovara"), (4, [(5, 5)], None), (5, [(0, 3), (100, 90), (200, 3)], "Ulica grada Vukovara")]
    drawn = line_frame(spark, [(7, [(-10, 0), (210, 0)], street, both), (8, [(0, 0)], street, both)], ", street string, both_ways boolean")
    got = L.match_drawn(drawn, line_frame(spark, edges, ", name string").withColumnRenamed("line", "edge")).collect()
    assert sorted((r.line, r.edge) for r in got) == [(7, e) for e in want]


def apart(x, z, p, q):
    dx, dz = q[0] - p[0], q[1] - p[1]
    square = dx * dx + dz * dz
    t = max(0.0, min(1.0, ((x - p[0]) * dx + (z - p[1]) * dz) / square)) if square > 0 else 0.0
    return math.hypot(x - p[0] - t * dx, z - p[1] - t * dz)


def test_drawn_lines_against_all_pairs(spark):
    """Edges meet the lines that their name can be of, and no others, before anything is measured."""
    rng = random.Random(12)
    names = ["ulica ilica", "Ilica", "Nova ilica", "nova  cesta", "Nova", None, ""]
    walk = lambda n, step: list(itertools.accumulate(range(n - 1), lambda p, _: (p[0] + rng.gauss(0, step), p[1] + rng.gauss(0, step)), initial=(rng.uniform(0, 300), rng.uniform(0, 300))))
    edges = [(k, walk(rng.randint(2, 4), 20), rng.choice(names)) for k in range(250)]
    drawn = [(k, walk(rng.randint(2, 6), 90), rng.choice(names), k % 2 == 0) for k in range(120)]
    drawn += [(900, [(0, 0), (0, 100), (math.inf, 0)], "", True), (901, [(math.nan, 0), (5, 5)], None, True), (902, [(0, 0)], None, True)]
    finite = lambda p, q: all(map(math.isfinite, (*p, *q)))
    street = lambda name: " ".join(w for w in (name or "").lower().split() if w not in ("ulica", "cesta"))
    want = set()
    for line, points, named, both in drawn:
        sides = [(p, q) for p, q in zip(points, points[1:], strict=False) if finite(p, q)]
        for edge, on, name in edges:
            (ax, az), (bx, bz) = on[0], on[-1]
            if not sides or street(named) not in street(name) or any(min(apart(*on[k], *s) for s in sides) > 20 for k in (0, len(on) // 2, -1)):
                continue
            p, q = min(sides, key=lambda s: apart((ax + bx) / 2, (az + bz) / 2, *s))  # noqa: B023
            along = ((bx - ax) * (q[0] - p[0]) + (bz - az) * (q[1] - p[1])) / math.dist(p, q) / math.dist(on[0], on[-1])
            if both or along >= 0.5:
                want.add((line, edge))
    got = L.match_drawn(line_frame(spark, drawn, ", street string, both_ways boolean"), line_frame(spark, edges, ", name string").withColumnRenamed("line", "edge"))
    assert len(want) > 50 and {(r.line, r.edge) for r in got.collect()} == want
    assert re.search(r"Join \[_cx#\d+L?, _cz#\d+L?, _street#", got._jdf.queryExecution().executedPlan().toString())


def test_names_with_streets(spark):
    names = ["nova ilica", "ilica", "", "aa", "aaa", "čaj\u00a0"]
    streets = ["", "ilica", "a", "aa", "nova ilica gornja", "č", "j\u00a0"]
    one = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    got = sorted((r.street, r.name) for r in L._names_with(one(names, "name"), one(streets, "street")).collect())
    assert got == sorted((s, n) for s in streets for n in names if s and s in n)


def test_crossings_against_all_pairs(spark):
    rng = random.Random(8)
    shapes = [(i, [(rng.uniform(-900, 900), rng.uniform(-900, 900)) for _ in range(4)]) for i in range(40)]
    ring = [(-500, -400), (600, -300), (300, 700), (-500, -400)]
    got = sorted((r.a, round(r.x, 5), round(r.z, 5)) for r in L.crossings(L.segments(line_frame(spark, shapes)), L.segments(line_frame(spark, [(0, ring)])), 130.0).collect())
    want = []
    for i, pts in shapes:
        for (ax, az), (bx, bz) in zip(pts, pts[1:], strict=False):
            for (cx, cz), (ex, ez) in zip(ring, ring[1:], strict=False):
                turn = (bx - ax) * (ez - cz) - (bz - az) * (ex - cx)
                t, u = ((cx - ax) * (ez - cz) - (cz - az) * (ex - cx)) / turn, ((cx - ax) * (bz - az) - (cz - az) * (bx - ax)) / turn
                if 0 <= t <= 1 and 0 <= u <= 1:
                    want.append((i, round(ax + t * (bx - ax), 5), round(az + t * (bz - az), 5)))
    assert got == sorted(want)


def test_segments_on_one_line_share_their_ends(spark):
    segs = lambda *pts: L.segments(line_frame(spark, [(0, pts)]))
    met = lambda a, b: sorted((r.x, r.z) for r in L.crossings(a, b, 50.0).collect())
    assert met(segs((0, 0), (100, 0)), segs((40, 0), (300, 0))) == [(40, 0), (100, 0)]
    assert met(segs((0, 0), (100, 0)), segs((0, 1), (100, 1))) == []


def test_counts_of_roads_over_the_edge(spark):
    box = line_frame(spark, [(0, [(-10_000, -10_000), (10_000, -10_000), (10_000, 10_000), (-10_000, 10_000), (-10_000, -10_000)])])
    gates = spark.createDataFrame([(1, -12_000.0, 0.0, ["A*"]), (2, 0.0, 11_000.0, ["D1"]), (3, 11_000.0, 0.0, ["D3"]), (4, 0.0, -11_000.0, []), (5, -12_000.0, 300.0, ["A*"])], "id int, x double, z double, roads array<string>")
    sections = [(1, [(-15_000, 0), (-5_000, 0)], ["A1", "A*"], 49_000.0), (2, [(0, 7_000), (0, 8_500)], ["D1"], 9_000.0), (3, [(1_000, 0), (2_000, 0)], ["D3"], 9_000.0)]
    out = L.assign_counts(gates, line_frame(spark, sections, ", roads array<string>, daily double").withColumnRenamed("line", "station"), box)
    assert {r.id: (r.station, r.tier, r.daily) for r in out.collect()} == {1: (1, 1, 24_500.0), 2: (2, 2, 9_000.0), 3: (None, None, None), 4: (None, None, None), 5: (1, 1, 24_500.0)}
