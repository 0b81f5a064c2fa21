"""Journeys over a graph of arcs: many-source searches by rounds of joins, best ways between places, loads along them.

A label is (cost, plain): generalised and plain seconds; the least cost counts, on a tie the least plain time. No graph and
no label passes through the driver; a round's tables go as soon as the next round has written its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanspark.sources.tables import discard, stored


def search(arcs: DataFrame, starts: DataFrame, most: float = float("inf")) -> DataFrame:
    """source, node, cost, plain, prev: the best label of each node that a source reaches at cost up to most, and the node
    before it (NULL at a start).

    arcs: src, dst, cost, plain (never negative); starts: source, node, cost, plain. Each round carries on only the labels
    that the last one improved, the smallest prev of equal ones; a label changes only for a better one, so rounds end and
    prev never runs in a circle. The arcs are written once, so that no round works them out again.
    """
    arcs = stored(arcs.select("src", "dst", "cost", "plain"), "arcs")
    first = starts.groupBy("source", "node").agg(F.min(F.struct("cost", "plain")).alias("l")).select("source", "node", "l.*")
    best = stored(first.select("*", F.lit(None).cast(arcs.schema["src"].dataType).alias("prev"), F.lit(True).alias("better")), "labels")
    a = arcs.select("src", "dst", F.col("cost").alias("w"), F.col("plain").alias("p"))
    while True:
        step = best.where("better").join(a, F.col("node") == F.col("src"))
        label = F.struct((F.col("cost") + F.col("w")).alias("cost"), (F.col("plain") + F.col("p")).alias("plain"), F.col("node").alias("prev"))
        found = step.where(F.col("cost") + F.col("w") <= most).groupBy("source", F.col("dst").alias("node")).agg(F.min(label).alias("l"))
        better = F.col("l").isNotNull() & (F.col("cost").isNull() | (F.struct("l.cost", "l.plain") < F.struct("cost", "plain")))
        pick = [F.when(F.col("better"), F.col(f"l.{c}")).otherwise(F.col(c)).alias(c) for c in ("cost", "plain", "prev")]
        new = stored(best.drop("better").join(found, ["source", "node"], "full").withColumn("better", better).select("source", "node", *pick, "better"), "labels")
        discard(best)
        best = new
        if best.where("better").isEmpty():
            discard(arcs)
            return best.drop("better")


def journeys(labels: DataFrame, legs: DataFrame) -> DataFrame:
    """source, place, cost, plain, node: the best way from each source to each other place that it reaches, and the node
    where it leaves the graph; nothing to a place itself.

    labels: as search() gives them, from the same legs; legs: place, node, cost, plain of the way between a place and a node.
    """
    out = legs.select("place", "node", F.col("cost").alias("w"), F.col("plain").alias("p"))
    ways = labels.join(out, "node").where("source <> place")
    label = F.struct((F.col("cost") + F.col("w")).alias("cost"), (F.col("plain") + F.col("p")).alias("plain"), "node")
    return ways.groupBy("source", "place").agg(F.min(label).alias("l")).select("source", "place", "l.*")


def boardings(labels: DataFrame, flows: DataFrame, lines: DataFrame) -> DataFrame:
    """line, boardings: flows led back along each source's tree of best ways, added up where they meet, counted on the arcs
    that board a line.

    flows: source, node, flow; lines: src, dst, line, share (an arc that boards one of several lines has a row for each).
    A round moves all flows one arc towards their sources, so there are as many as the longest way has arcs.
    """
    up = labels.where("prev is not null").select("source", "node", "prev")
    boards = lines.select(F.col("src").alias("prev"), F.col("dst").alias("node"), "line", "share")
    at, found = flows.groupBy("source", "node").agg(F.sum("flow").alias("flow")), []
    while True:
        moved = stored(at.join(up, ["source", "node"]), "flows")
        if moved.isEmpty():
            break
        found.append(moved)
        at = moved.groupBy("source", F.col("prev").alias("node")).agg(F.sum("flow").alias("flow"))
    discard(moved)
    if not found:
        return boards.limit(0).select("line", F.lit(0.0).alias("boardings"))
    taken = reduce(DataFrame.unionAll, found).join(boards, ["prev", "node"])
    return taken.groupBy("line").agg(F.sum(F.col("flow") * F.col("share")).alias("boardings"))


def paths(labels: DataFrame, ends: DataFrame) -> DataFrame:
    """source, node, path (nodes from the source on) of each of ends (source, node) that is reached, in rounds of joins."""
    up = labels.select("source", F.col("node").alias("at"), "prev")
    going = ends.select("source", "node").distinct().join(labels.select("source", "node"), ["source", "node"], "left_semi").select("source", "node", F.col("node").alias("at"), F.array("node").alias("path"))
    done = []
    while True:
        step = stored(going.join(up, ["source", "at"]), "paths")
        done.append(step.where("prev is null").select("source", "node", "path"))
        rest = step.where("prev is not null")
        if rest.isEmpty():
            return reduce(DataFrame.unionAll, done)
        going = rest.select("source", "node", F.col("prev").alias("at"), F.concat(F.array("prev"), "path").alias("path"))


def between_fractions(pairs: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """pairs (id, a, fa, b, fb) with seconds from the share fa along edge a to the share fb along edge b; NULL without a way.

    edges: edge, time; links: a, b, via (seconds between two edges). On one edge the way leads straight on, or, back to a
    place passed already, around by the shortest circle.
    """
    time = edges.select("edge", "time")
    arcs = stored(links.join(time.withColumnRenamed("edge", "b"), "b").select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("via") + F.col("time")).alias("cost"), F.lit(0.0).alias("plain")), "links")
    away = pairs.where("a <> b or fb < fa").select(F.col("a").alias("source")).distinct()
    # the first link is taken before the search, so that the label of the source itself is its shortest circle
    starts = away.join(arcs, F.col("source") == F.col("src")).select("source", F.col("dst").alias("node"), "cost", "plain")
    labels = search(arcs, starts).select(F.col("source").alias("a"), F.col("node").alias("b"), "cost")
    timed = pairs.join(time.withColumnsRenamed({"edge": "a", "time": "ta"}), "a").join(time.withColumnsRenamed({"edge": "b", "time": "tb"}), "b").join(labels, ["a", "b"], "left")
    ahead = (F.col("a") == F.col("b")) & (F.col("fb") >= F.col("fa"))
    around = (1 - F.col("fa")) * F.col("ta") + F.col("cost") - (1 - F.col("fb")) * F.col("tb")
    return timed.select("id", "a", "fa", "b", "fb", F.when(ahead, (F.col("fb") - F.col("fa")) * F.col("ta")).otherwise(around).alias("seconds"))


def traced_boundary(streets: DataFrame, digits: int = 2) -> DataFrame:
    """seq, x, z: the ring along streets in turn, each from where the one before comes nearest to where the next does.

    streets: ord (0, 1, ...), points (one row a line of the street). Points equal to digits decimals are one; where two
    streets meet is the closest pair of their points (the first by x, z of equals); along a street the shortest way over
    its lines is taken, or straight across where they do not join. Fewer than three streets give no ring.
    """
    n = F.size("points")
    at = lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["z"], digits).alias("z"))
    lines = streets.select("ord", F.transform("points", at).alias("points"))
    spots = lines.select("ord", F.explode("points").alias("p")).distinct()
    count = streets.agg((F.max("ord") + 1).alias("n")).first().n or 0
    if count < 3:
        return spots.limit(0).select(F.lit(0).cast("long").alias("seq"), "p.x", "p.z")
    after = spots.select(F.pmod(F.col("ord") - 1, F.lit(count)).alias("ord"), F.col("p").alias("q"))
    gap = F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.z") - F.col("q.z"))
    meet = stored(spots.join(after, "ord").groupBy("ord").agg(F.min(F.struct(gap.alias("d"), "p", "q")).alias("m")).select("ord", "m.p", "m.q"), "meetings")
    ends = meet.select("ord", F.col("p").alias("end")).join(meet.select(F.pmod(F.col("ord") + 1, F.lit(count)).alias("ord"), F.col("q").alias("start")), "ord")
    name = lambda p: F.struct("ord", p.alias("p"))
    sides = lines.where(n > 1).select("ord", F.inline(F.zip_with(F.slice("points", 1, n - 1), F.slice("points", 2, n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))))
    both = sides.unionAll(sides.select("ord", F.col("q").alias("p"), F.col("p").alias("q")))
    arcs = both.select(name(F.col("p")).alias("src"), name(F.col("q")).alias("dst"), F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.z") - F.col("q.z")).alias("cost"), F.lit(0.0).alias("plain"))
    labels = search(arcs, ends.select(F.col("ord").alias("source"), name(F.col("start")).alias("node"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("plain")))
    ways = paths(labels, ends.select(F.col("ord").alias("source"), name(F.col("end")).alias("node"))).select(F.col("source").alias("ord"), F.transform("path", lambda k: k["p"]).alias("way"))
    ring = ends.join(ways, "ord", "left").select("ord", F.posexplode(F.coalesce("way", F.array("start", "end"))).alias("k", "p"))
    order = Window.orderBy("ord", "k")  # one ring
    following = F.coalesce(F.lead("p").over(order), F.first("p").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ring.withColumn("next", following).where(~F.col("p").eqNullSafe(F.col("next")))
    return kept.select((F.row_number().over(order) - 1).cast("long").alias("seq"), "p.x", "p.z")
