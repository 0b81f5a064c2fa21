"""Loops go on until they are done, however many rounds that takes."""

from urbanspark.operators import graph, matching

LONG = 67


def test_long_paths(spark):
    arcs = spark.createDataFrame([(i, i + 1, 1.0) for i in range(LONG)], "src long, dst long, cost double").coalesce(1)
    got = {r.node: r.cost for r in graph.relax(arcs, spark.createDataFrame([(0,)], "node long"), 1e9).collect()}
    assert got == {i: float(i) for i in range(LONG + 1)}


def test_long_back_trace(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(LONG)] + [(100, 101), (101, 100)], "node long, prev long").coalesce(1)
    got = {r.start: r.path for r in matching.back_trace(tree).collect()}
    assert got == {i: list(range(i, -1, -1)) for i in range(LONG)} | {100: [100, 101], 101: [101, 100]}
