"""Rules, sources and walks on small exact cases."""

import itertools
import math
import random
import re
import struct
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from urbanspark.functions import formulas, rules, text
from urbanspark.operators import graph, matching, spatial
from urbanspark.sources import tables


def test_fold_is_the_decomposition(spark):
    def plain(name):
        name = "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c)).replace("đ", "d")
        return re.sub("[^a-z0-9]+", " ", name).strip()

    names = ["Příliš žluťoučký", "Straße", "ﬁn", "Őr", "İstanbul", "½ l", "e\u0301te\u0301", "Đakovo", "Ĳsel", "", *("x" + chr(i) + "y" for i in range(0x80, 0x2200, 3) if not 0xD800 <= i < 0xE000)]
    df = spark.createDataFrame([(x,) for x in names], "s string")
    assert {r.s: r.f for r in df.select("s", text.fold(F.col("s")).alias("f")).collect()} == {x: plain(x) for x in names}


def test_storeys_and_shares(spark):
    df = spark.createDataFrame([(3, 20.0), (0, 7.0), (0, 1.0)], "l int, e double")
    assert [r[0] for r in df.select(rules.storeys(F.col("l"), F.col("e"), 3.3)).collect()] == [3, 2, 1]
    b = spark.createDataFrame(
        [("house", None, 100.0, 6.0, False), ("commercial", None, 100.0, 6.0, False), ("minor", None, 20.0, 3.0, False), ("other", "industrial", 100.0, 6.0, False), ("other", None, 3000.0, 8.0, False), ("other", None, 100.0, 8.0, False), ("residential", None, 100.0, 8.0, True)],
        "kind string, land string, area double, eave double, centre boolean",
    )
    home, work = rules.use_shares(*map(F.col, b.columns))
    got = [(round(r.h, 2), round(r.w, 2)) for r in b.select(home.alias("h"), work.alias("w")).collect()]
    assert got == [(1, 0), (0, 1), (0, 0), (0, 1), (0, 1), (0.8, 0.2), (0.7, 0.3)]


def test_projection_and_sun(spark):
    east, north = formulas.transverse_mercator(F.lit(16.5), F.lit(45.0))
    r = spark.range(1).select(east.alias("e"), north.alias("n"), formulas.sun_elevation(F.lit(1_718_884_800.0), 45.81, 15.97).alias("noon"), formulas.sun_elevation(F.lit(1_718_928_000.0), 45.81, 15.97).alias("night")).first()
    assert (r.e, r.n) == (pytest.approx(500_000), pytest.approx(0.9999 * 4_984_944.378, abs=0.01))
    assert 60 < r.noon < 68 and r.night < -10


def test_places_mapped_twice(spark):
    rows = [(1, "school", "OŠ A", 0.0, 0.0), (2, "school", "OŠ A", 40.0, 0.0), (3, "school", "", 20.0, 0.0), (4, "school", "OŠ B", 30.0, 0.0), (5, "kindergarten", "OŠ A", 0.0, 0.0)]
    kept = spatial.deduplicate_places(spark.createDataFrame(rows, "id long, kind string, name string, x double, z double"))
    assert sorted((r.kind, r.name) for r in kept.collect()) == [("kindergarten", "OŠ A"), ("school", "OŠ A"), ("school", "OŠ B")]


def test_nearest_polygon(spark):
    square = lambda x: [(x, 0.0), (x + 10, 0.0), (x + 10, 10.0), (x, 10.0)]
    polygons = spark.createDataFrame([("a", 1, square(0.0)), ("b", 1, square(30.0))], "polygon string, priority int, ring array<struct<x: double, z: double>>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 18.0, 5.0), (3, 22.0, 5.0), (4, 500.0, 5.0)], "id long, x double, z double")
    assert {r.id: r.polygon for r in spatial.point_in_nearest_polygon(points, polygons, 20.0, 50.0).collect()} == {1: "a", 2: "a", 3: "b", 4: None}


def test_worst_approach(spark):
    edges = spark.createDataFrame([(1, 5.0, 0.2, 100.0), (2, 9.0, 0.3, 100.0), (3, 7.0, 0.2, 100.0), (4, 50.0, 0.9, 100.0), (5, 1.0, 0.1, 100.0)], "edge long, loss double, share double, length double")
    before = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 5), (5, 1)], "edge long, prev long")
    starts = spark.createDataFrame([(1,), (4,)], "edge long")
    assert {r.start: r.lost for r in graph.worst_approach(edges, before, starts, 1e9, 0.5).collect()} == {1: 15.0, 4: 50.0}
    assert {r.start: r.lost for r in graph.worst_approach(edges, before, starts, 150.0, 0.5).collect()} == {1: 14.0, 4: 50.0}


def test_stops_along_a_shape_by_brute_force(spark):
    rng = random.Random(3)
    trips = {k: [[(rng.randint(0, 1000) + 200.0 * i, float(rng.randint(0, 300))) for _ in range(3)] for i in range(rng.randint(1, 5))] for k in range(12)}

    def cost(path):
        steps = [b[0] - a[0] for a, b in zip(path, path[1:], strict=False)]
        return sum(c for _, c in path) + sum(steps) if all(s >= 0 for s in steps) else math.inf

    rows = [(k, i, c) for k, t in trips.items() for i, c in enumerate(t)]
    got = {}
    for r in matching.viterbi(spark.createDataFrame(rows, "trip long, seq int, choices array<struct<position: double, cost: double>>"), "trip").collect():
        got.setdefault(r.trip, {})[r.seq] = r.position
    for k, t in trips.items():
        paths = sorted((cost(p), [x for x, _ in p]) for p in itertools.product(*t))
        found = [got[k][i] for i in range(len(t))]
        if math.isinf(paths[0][0]):
            assert all(math.isnan(x) for x in found)
        else:
            assert found in [p for c, p in paths if c == paths[0][0]]


def test_inferred_lanes(spark):
    rows = [(1, 0, 1, "A", False, 4), (2, 1, 2, "A", False, None), (3, 2, 3, "A", False, None), (4, 3, 4, "B", False, None), (5, 0, 5, "A", True, None), (6, 3, 9, "A", False, 3)]
    got = {r.way: r.lanes for r in graph.inferred_lanes(spark.createDataFrame(rows, "way long, a long, b long, key string, oneway boolean, lanes int")).collect()}
    assert got == {2: 4, 3: 3}


def test_workbooks_and_shapes(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Zagreb</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>12.5</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert {(r.row, tuple(sorted(r.cells.items()))) for r in tables.read_sheets(spark, str(tmp_path / "a.xlsx")).collect()} == {(1, (("A", "Zagreb"), ("C", "12.5"))), (3, (("A", "x"),))}
    line = struct.pack("<BII4d", 1, 2, 2, 1.0, 2.0, 3.0, 4.0)
    ring = struct.pack(">BIII6d", 0, 3, 1, 3, *map(float, range(6)))
    df = spark.createDataFrame([(1, bytearray(line)), (2, bytearray(ring)), (3, None)], "id int, shape binary")
    got = {r.id: r.p and [(p.x, p.y) for p in r.p] for r in df.select("id", tables.wkb_points(F.col("shape")).alias("p")).collect()}
    assert got == {1: [(1.0, 2.0), (3.0, 4.0)], 2: [(0.0, 1.0), (2.0, 3.0), (4.0, 5.0)], 3: None}


def test_saved_state_is_checked(spark, tmp_path):
    path = str(tmp_path / "state")
    tables.save_state(spark.createDataFrame([(1, 5.0), (2, -1.0), (3, 7.0), (4, 8.0)], "day int, km double"), path)
    assert sorted(r.day for r in tables.load_state(spark, path, "day int, km double", F.col("km") >= 0, "day", 2).collect()) == [3, 4]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "stops.txt").write_bytes("\ufeffstop_id,stop_name\n1,Trg\n".encode())
    assert [tuple(r) for r in tables.read_gtfs(spark, str(tmp_path), "stops", "stop_id int, stop_name string").collect()] == [(1, "Trg")]
    (tmp_path / "d.json").write_text('[{"a": 1},\n {"b": "x"}]')
    assert sorted((r.a is None, r.b is None) for r in tables.read_documents(spark, str(tmp_path / "d.json"), "a int, b string").collect()) == [(False, True), (True, False)]
    tables.write_csv(spark.createDataFrame([(1, "a,b")], "i int, s string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first() == ("1", "a,b")
    tables.write_layer(spark.range(48).withColumn("hour", F.col("id") % 24), str(tmp_path / "hours"), ["id"], ["hour"])
    assert spark.read.parquet(str(tmp_path / "hours")).where("hour = 3").count() == 2 and (tmp_path / "hours" / "hour=3").exists()


def test_permission_lists(spark):
    mask = lambda *lists: spark.range(1).select(rules.permission_mask(*[F.lit(x).cast("string") for x in lists])).first()[0]
    bit = {name: b for name, (b, _) in rules.CLASSES.items()}
    assert mask(None, None) == sum(bit.values())
    assert mask("tram", None) == bit["tram"] and mask("", None) == 0 and mask("unknown  coach", "bus") == bit["bus"]
    no_rail = mask(None, "tram rail_urban rail rail_electric rail_fast subway pedestrian")
    assert no_rail == sum(bit.values()) - bit["tram"] - bit["rail"] - bit["pedestrian"]
    assert mask(None, "coach") & bit["bus"] and not mask(None, "coach bus") & bit["bus"]


def test_projection_and_back(spark):
    places = spark.range(400).select((13.5 + F.col("id") % 20 * 0.3).alias("lon"), (42.0 + F.floor(F.col("id") / 20) * 0.25).alias("lat"))
    lon, lat = formulas.degrees_of(*formulas.transverse_mercator(F.col("lon"), F.col("lat")))
    worst = places.select(F.max(F.abs(lon - F.col("lon"))).alias("lon"), F.max(F.abs(lat - F.col("lat"))).alias("lat")).first()
    assert worst.lon < 1e-6 and worst.lat < 1e-6


def test_viterbi_of_whole_batches(spark):
    """Trips of many lengths and numbers of choices, one without a way: by brute force, without a row at a time."""
    import itertools
    import math
    import random

    rng, schema = random.Random(5), "trip long, seq int, choices array<struct<position: double, cost: double>>"
    rows = [(t, s, [(100.0 * s + rng.randint(-150, 150), float(rng.randint(0, 90))) for _ in range(1 + (t + s) % 3)]) for t in range(40) for s in range(1, 2 + t % 4)] + [(99, 1, [(5.0, 0.0)]), (99, 2, [(1.0, 0.0)])]
    out = matching.viterbi(spark.createDataFrame(rows, schema), "trip")
    assert "Pandas" not in out._jdf.queryExecution().toString()
    got = {}
    for r in out.orderBy("trip", "seq").collect():
        got.setdefault(r.trip, []).append(r.position)
    for trip in {t for t, _, _ in rows}:
        ways = [w for w in itertools.product(*[c for t, _, c in rows if t == trip]) if all(b[0] >= a[0] for a, b in itertools.pairwise(w))]
        value = lambda w: sum(c for _, c in w) + w[-1][0] - w[0][0]
        if not ways:
            assert all(math.isnan(x) for x in got[trip])
        else:
            assert got[trip] in [[x for x, _ in w] for w in ways if value(w) == min(map(value, ways))]


def test_greedy_within_makes_few_pairs(spark, monkeypatch):
    """A dense place: equal to taking the nearest pair again and again, without all pairs within the cutoff."""
    import math
    import random

    rng = random.Random(9)
    a, b = ([(i, rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(n, n + 120)] for n in (0, 1000))
    made, plain = [], matching.greedy_pairs
    monkeypatch.setattr(matching, "greedy_pairs", lambda pairs: (made.append(pairs.count()), plain(pairs))[1])
    frame = lambda rows: spark.createDataFrame(rows, "id long, x double, z double")
    got = sorted((r.a, r.b) for r in matching.greedy_within(frame(a), frame(b), 100.0, 4).collect())
    want, used = [], set()
    for _, i, j in sorted((round(math.hypot(x - u, z - v), 6), i, j) for i, x, z in a for j, u, v in b if math.hypot(x - u, z - v) <= 100):
        if i not in used and j not in used:
            want.append((i, j))
            used |= {i, j}
    assert got == sorted(want)
    assert sum(made) < len(a) * len(b) / 4
