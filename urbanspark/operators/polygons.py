"""Overlap of convex polygons: groups of those in one cell, their pairs and exact areas in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanspark.functions.formulas import shoelace
from urbanspark.operators.spatial import cell

#: polygons of one cell, on either side, in one group; rows of a group compared, and pairs cut, at once
PIECE, ROWS, CUT = 2048, 256, 2048


def _sides(ring: Column) -> Column:
    """The ring's sides p, q."""
    n = F.size(ring)
    return F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def turned_left(ring: Column) -> Column:
    """The ring, backwards if it turns right."""
    twice = F.aggregate(_sides(ring), F.lit(0.0), lambda a, s: a + s["p"]["x"] * s["q"]["z"] - s["q"]["x"] * s["p"]["z"])
    return F.when(twice < 0, F.reverse(ring)).otherwise(ring)


def _border_inside(ring: np.ndarray, other: np.ndarray, shared: bool) -> np.ndarray:
    """Twice the area swept from the origin by the parts of ring's sides that lie in the convex ring other, both turning left,
    of many pairs, (x or z, corner, pair) in; shared: sides that lie on a side of other, in its direction, count."""
    (px, pz), (dx, dz) = ring, np.roll(ring, -1, axis=1) - ring
    (ox, oz), (ex, ez) = other, np.roll(other, -1, axis=1) - other
    low, high = np.zeros(px.shape), np.ones(px.shape)
    for k in range(other.shape[1]):
        # left of the edge where at + t * turn >= 0
        at, turn = ex[k] * (pz - oz[k]) - ez[k] * (px - ox[k]), ex[k] * dz - ez[k] * dx
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = -at / turn
        low, high = np.maximum(low, np.where(turn > 0, cut, 0.0)), np.minimum(high, np.where(turn < 0, cut, 1.0))
        beside = (turn == 0) & (at <= 0)
        if shared:
            beside &= (at != 0) | (ex[k] * dx + ez[k] * dz <= 0)
        low[beside] = 2.0
    # cross product of the part's ends
    return np.where(low < high, (high - low) * (px * dz - pz * dx), 0.0).sum(axis=0)


def shared_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Areas of the intersections of convex rings that turn left, (x or z, corner, pair) in: an intersection's border is what
    of each border lies in the other."""
    return np.maximum((_border_inside(a, b, True) + _border_inside(b, a, False)) / 2, 0.0)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _cut(left: pa.Table, right: pa.Table, picks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What the left and right polygons share, of the pairs of rows in picks."""
    flat, sizes, starts = [], [], []
    for rows in (left, right):
        rings = rows.column("corners").combine_chunks()
        flat.append(rings.flatten().to_numpy())
        sizes.append(pc.list_value_length(rings).to_numpy())
        starts.append(np.cumsum(sizes[-1]) - sizes[-1])
    shared = np.zeros(len(picks[0]))
    for at in range(0, len(shared), CUT):
        a, b = (p[at : at + CUT] for p in picks)
        na, nb, out = sizes[0][a], sizes[1][b], np.zeros(len(a))
        for n, m in np.unique(np.stack([na, nb], axis=1), axis=0):
            rows = np.flatnonzero((na == n) & (nb == m))
            corners = [f[np.arange(k).reshape(-1, 2).T[:, :, None] + s[p[rows]]] for f, k, s, p in zip(flat, (n, m), starts, (a, b), strict=True)]
            out[rows] = shared_areas(*corners)
        shared[at : at + CUT] = out
    return shared


def overlaps(left: DataFrame, right: DataFrame, size: float, least: float = 0.0, once: bool = False) -> DataFrame:
    """a, b, shared, area_a, area_b of each pair of convex polygons (id, ring) that share an area, least of the smaller one's at
    least, met in the cells of size that their bounding boxes cover; a pair counts once, in the first cell that both cover.

    once: of a pair met both ways round, only a < b. Pairs whose boxes share too little are never cut exactly. The polygons of a
    cell are dealt in pieces, and each left piece meets each right one in a group of its own. Rings with a corner that is not
    finite share nothing.
    """
    kinds = {"a": dict(left.dtypes)["id"], "b": dict(right.dtypes)["id"]}

    def spread(df: DataFrame, name: str) -> DataFrame:
        ends = [f(F.col(f"ring.{c}")) for c in "xz" for f in (F.array_min, F.array_max)]
        flat = F.flatten(F.transform(turned_left(F.col("ring")), lambda p: F.array(p["x"], p["z"])))
        finite = df.where(F.forall("ring", lambda p: (F.abs(p["x"]) < float("inf")) & (F.abs(p["z"]) < float("inf"))))
        ids = [(F.col("id") if k == name else F.lit(None).cast(kinds[k])).alias(k) for k in "ab"]
        boxed = finite.select(*ids, *[e.alias(k) for e, k in zip(ends, ("w0", "w1", "h0", "h1"), strict=True)], flat.alias("corners"), shoelace(F.col("ring")).alias("area"))
        boxed = boxed.withColumns({"x0": cell(F.col("w0"), size), "z0": cell(F.col("h0"), size)})
        return boxed.withColumn("_cx", F.explode(F.sequence("x0", cell(F.col("w1"), size)))).withColumn("_cz", F.explode(F.sequence("z0", cell(F.col("h1"), size))))

    a, b = spread(left, "a"), spread(right, "b")
    pieces = [rows.groupBy("_cx", "_cz").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias(f"_n{name}")) for rows, name in ((a, "a"), (b, "b"))]
    pieces = pieces[0].join(pieces[1], ["_cx", "_cz"])

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64(mine, "w0", "h0"), F.col(f"_n{mine}"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{other}") - 1))
        return rows.join(pieces, ["_cx", "_cz"]).withColumn(f"_{mine}", own).withColumn(f"_{other}", every).drop("_na", "_nb")

    def met(rows: pa.Table) -> pa.Table:
        sides = pc.equal(rows.column("side"), 0)
        sides = {"a": rows.filter(sides), "b": rows.filter(pc.invert(sides))}
        at = {(c, k): _column(sides[k], c) for k in "ab" for c in ("w0", "w1", "h0", "h1", "x0", "z0", "area")}
        cx, cz = rows.column("_cx")[0].as_py(), rows.column("_cz")[0].as_py()
        found = []
        for start in range(0, len(sides["a"]), ROWS):
            mine = {c: at[c, "a"][start : start + ROWS, None] for c in ("w0", "w1", "h0", "h1")}
            i, j = np.nonzero((mine["w0"] < at["w1", "b"]) & (mine["w1"] > at["w0", "b"]) & (mine["h0"] < at["h1", "b"]) & (mine["h1"] > at["h0", "b"]))
            i += start
            kept = (np.maximum(at["x0", "a"][i], at["x0", "b"][j]) == cx) & (np.maximum(at["z0", "a"][i], at["z0", "b"][j]) == cz)
            i, j = i[kept], j[kept]
            lap = [np.minimum(at[f"{c}1", "a"][i], at[f"{c}1", "b"][j]) - np.maximum(at[f"{c}0", "a"][i], at[f"{c}0", "b"][j]) for c in "wh"]
            kept = lap[0] * lap[1] >= (least - 1e-6) * np.minimum(at["area", "a"][i], at["area", "b"][j])
            i, j = i[kept], j[kept]
            if once:
                kept = pc.fill_null(pc.less(sides["a"].column("a").take(pa.array(i)), sides["b"].column("b").take(pa.array(j))), False).to_numpy()
                i, j = i[kept], j[kept]
            shared = _cut(sides["a"], sides["b"], (i, j))
            areas = at["area", "a"][i], at["area", "b"][j]
            kept = (shared > 0) & (shared >= least * np.minimum(*areas))
            ids = [sides[k].column(k).take(pa.array(p[kept])) for k, p in (("a", i), ("b", j))]
            found.append(pa.table([*ids, shared[kept], areas[0][kept], areas[1][kept]], names=["a", "b", "shared", "area_a", "area_b"]))
        return pa.concat_tables(found) if found else pa.table([sides[k].column(k).slice(0, 0) for k in "ab"] + [np.zeros(0)] * 3, names=["a", "b", "shared", "area_a", "area_b"])

    both = dealt(a, "a", "b").withColumn("side", F.lit(0)).unionByName(dealt(b, "b", "a").withColumn("side", F.lit(1)))
    group = ["_cx", "_cz", "_a", "_b"]
    # small groups make many pairs: their tasks are not to be joined for the little they read
    both = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)
    return both.groupBy(*group).applyInArrow(met, f"a {kinds['a']}, b {kinds['b']}, shared double, area_a double, area_b double")
