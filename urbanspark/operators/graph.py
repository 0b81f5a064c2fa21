"""Graph operators on arc tables (src, dst, cost)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanspark.operators.journeys import paths, search


def relax(arcs: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """source, node, cost: least costs up to most, by rounds of joins on the frontiers that the last round improved."""
    starts = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"), F.lit(0.0).alias("plain"))
    return search(arcs.select("src", "dst", "cost", F.lit(0.0).alias("plain")), starts, most).select("source", "node", "cost")


def fastest_paths(arcs: DataFrame, queries: DataFrame, most: float = float("inf")) -> DataFrame:
    """source, target, cost, path of each query (source, target); NULLs where the target is out of reach."""
    starts = queries.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("plain")).distinct()
    labels = search(arcs.select("src", "dst", "cost", F.lit(0.0).alias("plain")), starts, most)
    ways = paths(labels, queries.select("source", F.col("target").alias("node")))
    costs = labels.select("source", F.col("node").alias("target"), "cost")
    return queries.join(costs, ["source", "target"], "left").join(ways.withColumnRenamed("node", "target"), ["source", "target"], "left").select("source", "target", "cost", "path")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node reachable along edges (a, b), by large and small stars in turn.

    Each round is written and read back: plans of earlier rounds would pile up in the driver.
    """
    from urbanspark.sources.tables import discard, stored

    ends = stored(edges.select("a", "b").distinct(), "edges")
    e = stored(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        new = stored(small.distinct(), "stars")
        discard(e, large)
        e = new
        open_ = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u").unionAll(e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi"))
        if open_.isEmpty():
            nodes = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct()
            return nodes.join(e.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def routing_arcs(links: DataFrame) -> DataFrame:
    """One arc per (src, dst): least penalty, union of the classes; a turn back only where there is no other way on.

    links: src, dst, classes (bits), cost, turn ('straight', 'left', 'back').
    """
    penalty = F.when(F.col("turn") == "left", 4.0).when(F.col("turn") == "back", 60.0).otherwise(0.0)
    onward = links.where("turn <> 'back'").select("src").distinct()
    usable = links.where("turn <> 'back'").unionByName(links.where("turn = 'back'").join(onward, "src", "left_anti"))
    return usable.groupBy("src", "dst").agg(F.bit_or("classes").alias("classes"), F.min(F.col("cost") + penalty).alias("cost"))


def worst_approach(edges: DataFrame, before: DataFrame, starts: DataFrame, reach: float, slow: float) -> DataFrame:
    """start, lost: seconds lost on the way upstream from each start, always onto the slow edge that loses most (the smaller
    id of equals), until none is left or reach metres are walked.

    edges: edge, loss, share, length; before: edge, prev. Each round adds an unseen edge to a walk, so the rounds end.
    """
    from urbanspark.sources.tables import checkpointed

    e = checkpointed(edges.select("edge", "loss", "share", "length"))
    first = starts.select(F.col("edge").alias("start")).distinct().join(e.select(F.col("edge").alias("start"), "loss", "length"), "start")
    walk = checkpointed(first.select("start", F.col("start").alias("at"), F.col("loss").alias("lost"), F.col("length").alias("metres"), F.array("start").alias("seen")))
    done = walk.limit(0).select("start", "lost")
    options = before.select(F.col("edge").alias("at"), "prev").join(e.select(F.col("edge").alias("prev"), F.col("loss").alias("more"), "share", F.col("length").alias("step")), "prev").where(F.col("share") < slow)
    options = checkpointed(options.select("at", "prev", "more", "step"))
    while not walk.isEmpty():
        going = walk.where(F.col("metres") < reach).join(options, "at").where(~F.array_contains("seen", F.col("prev")))
        best = going.groupBy("start").agg(F.max_by(F.struct("lost", "metres", "seen", "prev", "more", "step"), F.struct(F.col("more"), -F.col("prev"))).alias("b")).select("start", "b.*")
        best = checkpointed(best)
        done = checkpointed(done.unionByName(walk.join(best.select("start"), "start", "left_anti").select("start", "lost")))
        walk = checkpointed(best.select("start", F.col("prev").alias("at"), (F.col("lost") + F.col("more")).alias("lost"), (F.col("metres") + F.col("step")).alias("metres"), F.concat("seen", F.array("prev")).alias("seen")))
    return done


def inferred_lanes(ways: DataFrame, rounds: int = 4) -> DataFrame:
    """way, lanes of ways without a count: the fewest lanes of ways joined to their ends with the same key and direction, in
    rounds, so that counts spread along chains; only those above one lane each way.

    ways: way, a, b (end nodes), key (name, class; NULL: none), oneway (boolean), lanes (NULL: unknown). The rounds are the
    rule's own reach.
    """
    from urbanspark.sources.tables import checkpointed

    w = checkpointed(ways.select("way", "a", "b", "key", "oneway", "lanes").withColumn("found", F.lit(False)))
    for _ in range(rounds):
        ends = w.select("way", F.explode(F.array("a", "b")).alias("node"), "key", "oneway", "lanes")
        known = ends.where("lanes is not null").select(F.col("way").alias("other"), "node", "key", "oneway", F.col("lanes").alias("n"))
        # fewest lanes of any way at an end, and of any but that one: no pair of ways is made
        at = ["node", "key", "oneway"]
        least = known.groupBy(*at).agg(F.min(F.struct("n", "other")).alias("b")).select(*at, "b.*")
        others = known.join(least.select(*at, F.col("other").alias("mine")), at).where("other <> mine").groupBy(*at).agg(F.min("n").alias("second"))
        both = checkpointed(least.join(others, at, "left"))
        met = ends.where("lanes is null and key is not null").join(both, at)
        new = met.groupBy("way").agg(F.min(F.when(F.col("way") == F.col("other"), F.col("second")).otherwise(F.col("n"))).alias("n"))
        w = checkpointed(w.join(new, "way", "left").select("way", "a", "b", "key", "oneway", F.coalesce("lanes", "n").alias("lanes"), (F.col("found") | F.col("n").isNotNull()).alias("found")))
    return w.where("found and lanes >= case when oneway then 2 else 3 end").select("way", "lanes")
