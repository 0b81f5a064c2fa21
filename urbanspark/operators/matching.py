"""Matching of rows in rounds, along sequences and by first description that resolves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanspark.operators.spatial import within


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs (a, b, dist) by ascending distance: each round keeps the pairs that are best for both sides.

    The order (dist, a, b) is total, so the result is that of taking the nearest pair again and again. Each round takes
    the nearest pair left, at least, so the rounds end.
    """
    from urbanspark.sources.tables import checkpointed

    left = checkpointed(pairs.select("a", "b", "dist").where("a is not null and b is not null and dist is not null"))
    taken = None
    while True:
        rank = F.struct("dist", "a", "b")
        best_a = left.groupBy("a").agg(F.min(rank).alias("p"))
        best_b = left.groupBy("b").agg(F.min(rank).alias("q"))
        now = checkpointed(best_a.join(best_b, F.col("p") == F.col("q")).select("p.*"))
        taken = now if taken is None else checkpointed(taken.unionByName(now))
        left = checkpointed(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti"))
        if left.isEmpty():
            break
    return taken.select("a", "b", "dist")


def greedy_within(left: DataFrame, right: DataFrame, cutoff: float, halvings: int = 7) -> DataFrame:
    """greedy_pairs() of the (id, x, z) rows of left (a) and right (b) at most cutoff apart, dist to six digits.

    Nearer pairs come first, so the pairs up to a radius can be settled before wider ones are made; the radius doubles up
    to cutoff. Where points are dense most are taken early, and pairs grow with the points and not with their square.
    """
    from urbanspark.sources.tables import checkpointed

    a, b = checkpointed(left.select("id", "x", "z")), checkpointed(right.select("id", "x", "z"))
    taken = []
    for k in range(halvings, -1, -1):
        radius = cutoff / 2**k
        pairs = within(a, b, radius).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.round("dist", 6).alias("dist"))
        if k:  # one beyond the radius may be as near when rounded
            pairs = pairs.where(F.col("dist") < radius * (1 - 1e-9) - 1e-5)
        taken.append(greedy_pairs(pairs))
        if k:
            a = checkpointed(a.join(taken[-1].select(F.col("a").alias("id")), "id", "left_anti"))
            b = checkpointed(b.join(taken[-1].select(F.col("b").alias("id")), "id", "left_anti"))
    return reduce(DataFrame.unionAll, taken)


def independent(conflicts: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rows (id, rank) that stay when each row loses to a better one it conflicts with (a, b both ways) that stays.

    Each round decides the best row left, at least, so the rounds end.
    """
    from urbanspark.sources.tables import checkpointed

    left, kept = checkpointed(ranked.where("id is not null").select("id", "rank")), ranked.where("id is null").select("id", "rank")
    edges = checkpointed(conflicts.select("a", "b").distinct())
    while True:
        mine, other = left.select(F.col("id").alias("a"), F.col("rank").alias("ra")), left.select(F.col("id").alias("b"), F.col("rank").alias("rb"))
        beaten = edges.join(mine, "a").join(other, "b").where((F.col("rb") < F.col("ra")) | ((F.col("rb") == F.col("ra")) & (F.col("b") < F.col("a")))).select(F.col("a").alias("id")).distinct()
        now = checkpointed(left.join(beaten, "id", "left_anti"))
        kept = checkpointed(kept.unionByName(now))
        gone = now.join(edges, now.id == edges.a).select(F.col("b").alias("id")).union(now.select("id"))
        left = checkpointed(left.join(gone, "id", "left_anti"))
        if left.isEmpty():
            break
    return kept.select("id", "rank")


def first_spec(candidates: DataFrame, key: list[str]) -> DataFrame:
    """The candidates of the first description (spec) that has any, per key."""
    first = F.min("spec").over(Window.partitionBy(*key))
    return candidates.withColumn("_s", first).where("spec = _s").drop("_s")


def viterbi(observed: DataFrame, key: str, weight: float = 1.0) -> DataFrame:
    """Best positions for the ordered observations of each key: (key, seq, position).

    observed: key, seq, choices array<struct<position, cost>>. A step back costs what is walked, forward nothing more
    than its length times weight. A key's observations are a trip's stops, tens of rows.
    """

    def best_paths(at: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """Positions of trips of one length, (trip, stop, choice) in; choices that are not there cost infinity."""
        total, back = cost[:, 0], []
        for k in range(1, at.shape[1]):
            step = at[:, k, None, :] - at[:, k - 1, :, None]
            move = np.where(step >= 0, step * weight, np.inf) + total[:, :, None]
            back.append(move.argmin(axis=1))
            total = move.min(axis=1) + cost[:, k]
        best = [total.argmin(axis=1)]
        for b in reversed(back):
            best.append(np.take_along_axis(b, best[-1][:, None], axis=1)[:, 0])
        places = np.take_along_axis(at, np.stack(best[::-1], axis=1)[:, :, None], axis=2)[:, :, 0]
        return np.where(np.isfinite(total).any(axis=1)[:, None], places, np.nan)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column("seen")
            stops, sizes = seen.flatten(), pc.list_value_length(seen).to_numpy(zero_copy_only=False)
            choices = stops.field("choices")
            n = pc.list_value_length(choices).to_numpy(zero_copy_only=False)
            inside = np.arange(n.max(initial=0)) < n[:, None]
            at, cost = np.zeros(inside.shape), np.full(inside.shape, np.inf)
            at[inside] = choices.flatten().field("position").to_numpy(zero_copy_only=False)
            cost[inside] = choices.flatten().field("cost").to_numpy(zero_copy_only=False)
            starts, places = np.cumsum(sizes) - sizes, np.empty(len(stops))
            for size in np.unique(sizes):
                rows = starts[sizes == size][:, None] + np.arange(size)
                places[rows] = best_paths(at[rows], cost[rows])
            keys = batch.column(key).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), stops.field("seq").cast(pa.int32()), pa.array(places)], [key, "seq", "position"])

    # one row a trip, many trips a batch
    seen = observed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "choices"))).alias("seen"))
    return seen.mapInArrow(solve, f"{key} long, seq int, position double")


def back_trace(previous: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Paths from (node, prev) tables: start, path; joins the next step on until every path ends, or would meet itself.

    starts: the nodes (node) to trace, all of them if left out.
    """
    from urbanspark.sources.tables import checkpointed

    first = previous if starts is None else previous.join(starts.select("node").distinct(), "node", "left_semi")
    paths = checkpointed(first.select(F.col("node").alias("start"), F.array("node").alias("path"), F.col("prev").alias("at")))
    step = previous.select(F.col("node").alias("at"), F.col("prev").alias("up"))
    # the paths that end in a round stay where it wrote them
    done = [paths.where("at is null").select("start", "path")]
    while True:
        paths = paths.where("at is not null and not array_contains(path, at)")
        if paths.isEmpty():
            return reduce(DataFrame.unionAll, done)
        paths = checkpointed(paths.join(step, "at", "left").select("start", F.concat("path", F.array("at")).alias("path"), F.col("up").alias("at")))
        done.append(paths.where("at is null or array_contains(path, at)").select("start", "path"))
