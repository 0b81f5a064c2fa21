"""Work that must not grow with the square of the input: arcs read once, places in dense cells, results as brute force has them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from urbanspark.operators import graph, matching, spatial
from urbanspark.operators import journeys as J
from urbanspark.sources import tables


def test_search_reads_its_arcs_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    arcs = spark.createDataFrame([(k, k + 1, 1.0, 0.0) for k in range(6)], "src long, dst long, cost double, plain double").coalesce(1).mapInPandas(counted, "src long, dst long, cost double, plain double")
    starts = spark.createDataFrame([(0, 0, 0.0, 0.0)], "source long, node long, cost double, plain double")
    assert {r.node: r.cost for r in J.search(arcs, starts).collect()} == {k: float(k) for k in range(7)}
    assert read.value == 6


def places(n, seed, wide=400.0):
    rng = random.Random(seed)
    return [(k, rng.choice("ab"), rng.choice(["", "", "n1", "n2"]), rng.gauss(0, wide), rng.gauss(0, wide)) for k in range(n)]


@pytest.mark.parametrize("n, wide", [(150, 400.0), (600, 60.0)])
def test_clusters_as_brute_force(spark, n, wide):
    rows = [(k, x, z) for k, _, _, x, z in places(n, n, wide)] + [(9000 + k, 5000.0 + 70 * k, 0.0) for k in range(9)] + [(9100, 9000.0, 0.0), (9101, 9000.0, 0.0)]
    got = {r.node: r.component for r in spatial.clusters(spark.createDataFrame(rows, "id long, x double, z double"), 70.0).collect()}
    label = {}
    for i, _, _ in rows:
        if i in label:
            continue
        seen, todo = {i}, [i]
        while todo:
            a = rows[[r[0] for r in rows].index(todo.pop())]
            for b in rows:
                if b[0] not in seen and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 4900:
                    seen.add(b[0])
                    todo.append(b[0])
        label.update(dict.fromkeys(seen, min(seen) if len(seen) > 1 else None))
    assert got == {k: v for k, v in label.items() if v is not None}


def test_long_chain_is_one_component(spark):
    """A chain in shuffled names: rounds grow with its logarithm, and plans of earlier rounds don't pile up."""
    names = list(range(300))
    random.Random(1).shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)), "a long, b long")
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(k, 0) for k in range(300)}


def test_nearest_makes_few_pairs_in_a_crowd(spark, monkeypatch):
    rng = random.Random(3)
    left = [(k, rng.gauss(0, 30), rng.gauss(0, 30)) for k in range(300)] + [(900, 250.0, 0.0), (901, 9000.0, 0.0)]
    right = [(k, k % 3, rng.gauss(0, 30), rng.gauss(0, 30)) for k in range(3000)]
    made, within = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a, **k: made.append(within(*a, **k)) or made[-1])
    counts = []
    monkeypatch.setattr("urbanspark.sources.tables.discard", lambda *a: counts.append(0))
    schema = "x double, z double"
    out = spatial.nearest(spark.createDataFrame(left, f"id long, {schema}"), spark.createDataFrame(right, f"id long, kind int, {schema}"), 400.0, F.when(F.col("r_kind") == 1, 0).otherwise(1))
    want = {}
    for i, x, z in left:
        near = [(b[1] != 1, round(math.dist((x, z), b[2:]), 6), b[0]) for b in right if math.dist((x, z), b[2:]) <= 400]
        want[i] = min(near)[2] if near else None
    assert {r.id: r.nearest for r in out.collect()} == want
    assert sum(m.count() for m in made[:1]) < 300 * 300  # all pairs: 301 x 1000


@pytest.mark.parametrize("wide", [400.0, 50.0])
def test_spaced_as_one_by_one(spark, wide):
    rows = [(k, (k * 7919) % 50, kind, x, z) for k, kind, _, x, z in places(400, 5, wide)] + [(1000, 0, None, 0.0, 0.0), (1001, 0, "a", None, 0.0)]
    kept = []
    for r in sorted(rows[:-2], key=lambda r: r[1::-1]):
        if not any(r[2] == k[2] and math.dist(r[3:], k[3:]) <= 150 for k in kept):
            kept.append(r)
    out = spatial.spaced(spark.createDataFrame(rows, "id long, rank long, kind string, x double, z double"), 150.0, ("kind",)).collect()
    assert sorted(r.id for r in out) == sorted([k[0] for k in kept] + [1000, 1001])


def test_paths_are_written_once(spark, monkeypatch):
    written = []
    before = tables.checkpointed
    monkeypatch.setattr(tables, "checkpointed", lambda df: written.append(before(df)) or written[-1])
    tree = spark.createDataFrame([(k, k // 2 if k > 1 else None) for k in range(1, 65)], "node long, prev long")
    assert {r.start: len(r.path) for r in matching.back_trace(tree).collect()} == {k: k.bit_length() for k in range(1, 65)}
    assert sum(w.count() for w in written) <= sum(k.bit_length() for k in range(1, 65))
