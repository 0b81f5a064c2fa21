"""Near duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of HALVES half keys, each made of ROWS minhashes, are computed per document; a table's key is a
pair of half keys, one from each collection, so 2 x HALVES x ROWS minhashes serve HALVES^2 tables of 2 x ROWS rows.
Documents with the same shingle set form a class and go on as one. Half keys that nobody shares drop out before any pair
of half keys is formed. Buckets with the same members are kept once. In each bucket every class is first compared with
the bucket's smallest one, then what is left apart with the most central one; members still in different components are
compared with each other, but for pairs whose parts in and outside a common pivot keep them below the threshold. So no
bucket is capped, and no pairs are made where all members are linked already. Links are confirmed by intersecting full
sets, components come from repeated minimum labels with pointer jumping, all on tables in the shared folder.

A pair at similarity s meets in no table with probability 1 - (1 - (1 - s^ROWS)^HALVES)^2: 1e-4 at 0.75.

Edge cases: null, empty and blank texts have the empty set and no links. Texts shorter than a shingle are one shingle.
Repeated rows are all returned; rows that share a key are one node, with the links of all their texts. Keys are whole
numbers below 2^62. Rows with a null key get no links. Texts are read
whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, stored
from .shingles import constants, mix, shingle_sets

HALVES = 12
ROWS = 2
SIMILARITY = 75
_FACTORS = constants(2 * HALVES * ROWS, 3)
_SET_SALT = constants(2, 4)


def _prints(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints of each set."""
    full, out = np.flatnonzero(sizes), np.zeros((2, len(sets)), np.uint64)
    if len(full):
        flat, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
        out[0, full] = np.add.reduceat(mix(flat ^ _SET_SALT[0]), starts)
        out[1, full] = np.bitwise_xor.reduceat(mix(flat ^ _SET_SALT[1]), starts)
    return out


def _signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sets in shingle_sets(batch.column(1)):
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(sets), 2 * HALVES), np.uint64)
            prints = _prints(sets, sizes)
            if len(full):
                flat = np.concatenate(sets)
                starts = (np.cumsum(sizes) - sizes)[full]
                for k in range(2 * HALVES):
                    low = [np.minimum.reduceat(flat * _FACTORS[k * ROWS + r], starts) for r in range(ROWS)]
                    keys[full, k] = mix(sum(mix(x + np.uint64(r)) for r, x in enumerate(low)) + np.uint64(k))
            flat_keys = pa.array(keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(sets)), pa.array(sizes), *[pa.array(p.view(np.int64)) for p in prints], pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * 2 * HALVES, flat_keys)],
                ["key", "n", "f1", "f2", "halves"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sets in shingle_sets(batch.column(1)):
            sizes = np.array([len(s) for s in sets], np.int64)
            offsets = np.cumsum([0, *sizes]).astype(np.int32)
            prints = [pa.array(p.view(np.int64)) for p in _prints(sets, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), *prints, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))], ["key", "f1", "f2", "shingles"])


def _nodes_of(by_set: DataFrame) -> DataFrame:
    """by_set (f1, f2, n, key: the least key with the set) with rep, one number a class: its key, where no other class has it,
    else a number above all keys for all classes of that key but one."""
    more = by_set.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("f1", "f2", "n")).alias("first")).where("c > 1").select("key", "first")
    others = stored(by_set.join(more, "key").where(F.struct("f1", "f2", "n") != F.col("first")).select("f1", "f2", "n"), "other-classes")
    if others.isEmpty():
        return by_set.withColumn("rep", F.col("key"))
    most = by_set.agg(F.max("key")).first()[0]
    numbered = stored(others.withColumn("rep", F.lit(most) + 1 + F.monotonically_increasing_id()), "numbered-classes")
    return stored(by_set.join(numbered, ["f1", "f2", "n"], "left").withColumn("rep", F.coalesce("rep", "key")), "class-nodes")


def _bucket_members(classes: DataFrame) -> DataFrame:
    """bucket, rep, n: the members of each distinct bucket of two or more classes; n is a class's set size."""
    halves = classes.select("rep", "n", F.posexplode("halves").alias("side", "half"))
    shared = stored(halves.groupBy("side", "half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("side", "half"), "half-keys")
    left = halves.join(shared, ["side", "half"], "left_semi").groupBy("rep", "n").agg(F.collect_list(F.struct("side", "half")).alias("h"))
    one = F.filter("h", lambda x: x["side"] < HALVES)
    two = F.filter("h", lambda x: x["side"] >= HALVES)
    keys = F.flatten(F.transform(one, lambda a: F.transform(two, lambda b: F.xxhash64(a["side"], a["half"], b["side"], b["half"]))))
    tables = stored(left.select("rep", "n", F.explode(keys).alias("bucket")), "tables")
    buckets = tables.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("least"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("size > 1")
    once = buckets.groupBy("size", "least", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "least")
    return stored(tables.join(once, "bucket"), "buckets")


def _sizes_fit(a: str, b: str):
    return (100 * F.least(a, b) >= SIMILARITY * F.greatest(a, b))


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """key, shingles of the classes in ids (rep, key, f1, f2), read from a row with their key and fingerprints; key: the class."""
    ids = stored(ids, "set-keys")
    wanted = docs.where(bit_filter(ids.select(F.xxhash64("key")))(F.xxhash64("key"))).join(ids, "key", "left_semi")
    found = wanted.mapInArrow(_sets, "key long, f1 long, f2 long, shingles array<long>").join(ids, ["key", "f1", "f2"])
    return stored(found.select(F.col("rep").alias("key"), "shingles").dropDuplicates(["key"]), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    with_b = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return stored(both.where(100 * shared >= SIMILARITY * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "links")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with label, their component by links."""
    found = components(links)
    labelled = members.join(found.select(F.col("node").alias("rep"), "label"), "rep", "left").select("bucket", "rep", "n", F.coalesce("label", "rep").alias("label"))
    return stored(labelled, "members")


def _open_members(labelled: DataFrame, classes: DataFrame) -> DataFrame:
    """pivot, rep, label, n, centre, at of the members of buckets with several components; pivot: the label of the bucket's
    largest, at: the centre's.

    centre is the member that has the half keys most of the pivot's members have. It differs least from the others, so they
    share least outside it: one with edits of its own would leave outside, in every other member, what it has lost.
    """
    labels = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    main = labels.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("pivot"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    members = stored(labelled.join(main, "bucket").select("pivot", "rep", "label", "n").distinct(), "open-members")
    held = stored(members.drop("n").join(classes.select("rep", F.posexplode("halves").alias("side", "half")), "rep"), "member-keys")
    counts = held.groupBy("pivot", "side", "half").agg(F.count(F.lit(1)).alias("c"))
    score = held.join(counts, ["pivot", "side", "half"]).groupBy("pivot", "rep").agg(F.sum("c").alias("c"), F.first("label").alias("label"))
    best = score.groupBy("pivot").agg(F.max_by(F.struct(F.col("rep").alias("centre"), F.col("label").alias("at")), F.struct("c", -F.col("rep"))).alias("b"))
    return members.join(stored(best.select("pivot", "b.*"), "centres"), "pivot")


def _open_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that may still be similar enough.

    The members (of buckets with several components) are compared with a pivot set, that of their centre. What two members share lies in the pivot, at most the smaller of their parts in it, or outside, where it is
    counted exactly by joining on the shingles. So a pair is found by a shared shingle outside the pivot, or its parts in
    the pivot are large enough by themselves; members whose parts in the pivot and shared shingles are too few together
    are in no pair. One side of every pair is outside the largest component.

    The join on shingles takes prefixes only. A pair needs SIMILARITY * (na + nb) / (100 + SIMILARITY) common shingles, of
    which the pivot holds at most c of either side. So outside it the larger member needs SIMILARITY / 100 * n - c of its own
    shingles, the smaller one 2 * SIMILARITY / (100 + SIMILARITY) * n - c, and two members with that many in common meet in
    one that is left when each side, in one order by rareness, gives up the commonest it can spare. Where they meet first,
    they share no rarer ones, so what either side has from there on must be enough, too. The pairs that meet are then
    counted over all their shingles outside.
    """
    sides = members.join(sets.select(F.col("key").alias("rep"), F.col("shingles").alias("s")), "rep").join(sets.select(F.col("key").alias("centre"), F.col("shingles").alias("p")), "centre")
    parts = stored(sides.select("pivot", "rep", "label", "n", F.array_except("s", "p").alias("out")), "pivot-parts")
    outside = parts.select("pivot", "rep", "label", F.explode("out").alias("x"))
    common = outside.groupBy("pivot", "x").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("pivot", "x")
    shared = stored(outside.join(common, ["pivot", "x"]), "shared-shingles")
    n_shared = shared.groupBy("pivot", "rep").agg(F.count(F.lit(1)).alias("k"))
    able = parts.select("pivot", "rep", "label", "n", (F.col("n") - F.size("out")).alias("c")).join(n_shared, ["pivot", "rep"], "left")
    able = stored(able.where(100 * (F.col("c") + F.coalesce("k", F.lit(0))) >= SIMILARITY * F.col("n")).drop("k"), "able-members")

    def side(df: DataFrame, r: str, *more: str | Column) -> DataFrame:
        return df.select("pivot", F.col("rep").alias(r), *[F.col(c).alias(f"{c}{r}") for c in ("label", "n", "c")], *more)

    def fit(both):
        return 100 * both >= SIMILARITY * (F.col("na") + F.col("nb") - both)

    least, differ = F.least("ca", "cb"), F.col("labela") != F.col("labelb")
    rows = stored(shared.join(able.select("pivot", "rep", "n", "c"), ["pivot", "rep"]), "able-shingles")
    # shingles with the same members (an edit changes several) count as one with a weight
    alike = rows.groupBy("pivot", "x").agg(F.count(F.lit(1)).alias("f"), F.bit_xor(F.xxhash64("rep")).alias("u"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("v"))
    alike = alike.where("f > 1").groupBy("pivot", "f", "u", "v").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("w")).select("pivot", "x", "w", "f")
    rows = stored(rows.join(alike, ["pivot", "x"]), "weighted-shingles")
    # prefix filter: a member's rarest kinds, but for the last whose weight is less than what a pair needs outside the pivot
    left = F.sum("w").over(Window.partitionBy("pivot", "rep").orderBy(F.desc("f"), F.desc("x"))) + F.col("c")
    rare = stored(rows.withColumn("left", left).where(100 * F.col("left") >= SIMILARITY * F.col("n")), "prefixes")
    larger = side(rare, "b", "x", F.col("left").alias("leftb"))
    smaller = side(rare.where((100 + SIMILARITY) * F.col("left") >= 2 * SIMILARITY * F.col("n")), "a", "x", F.col("left").alias("lefta"))
    order = F.struct("na", "a") < F.struct("nb", "b")
    main_a, main_b = F.col("labela") == F.col("pivot"), F.col("labelb") == F.col("pivot")
    met = smaller.where(~main_a).join(larger, ["pivot", "x"]).union(smaller.where(main_a).join(larger.where(~main_b), ["pivot", "x"]))
    enough = fit(least + F.least(F.col("lefta") - F.col("ca"), F.col("leftb") - F.col("cb")))
    met = stored(met.where(order & differ & _sizes_fit("na", "nb") & enough).select("pivot", "a", "b", "na", "nb", "ca", "cb").distinct(), "met")
    kinds = stored(rows.groupBy("pivot", "rep").agg(F.collect_list(F.struct("x", "w")).alias("k")), "kinds")
    both = met.join(kinds.select("pivot", F.col("rep").alias("a"), F.col("k").alias("sa")), ["pivot", "a"]).join(kinds.select("pivot", F.col("rep").alias("b"), F.col("k").alias("sb")), ["pivot", "b"])
    weight = F.aggregate(F.array_intersect("sa", "sb"), F.lit(0).cast("long"), lambda t, k: t + k["w"])
    met = both.where(fit(least + weight))
    large = able.where(100 * F.col("c") >= SIMILARITY * F.col("n"))
    inside = side(large.where("label <> pivot"), "a").join(side(large, "b"), "pivot").where(differ & fit(least))
    return met.select("a", "b").union(inside.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node each node of the links (a, b) reaches."""
    both = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u <> v"), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = stored(lower.join(jump, "label", "left").select("node", "old", F.least(F.col("label"), F.col("up")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            return labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row: key, n_shingles, component_id, kept, class_id (smallest key with the same set)."""
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = stored(docs.mapInArrow(_signature, "key long, n long, f1 long, f2 long, halves array<long>"), "signatures")
    nodes = signed.where("n > 0 and key is not null")
    by_set = _nodes_of(stored(nodes.groupBy("f1", "f2", "n").agg(F.min("key").alias("key")), "classes"))
    classes = nodes.join(by_set, ["f1", "f2", "n", "key"]).dropDuplicates(["f1", "f2", "n"])
    by_set = by_set.drop("key")
    members = _bucket_members(classes)
    sizes = members.select(F.col("rep").alias("least"), F.col("n").alias("m")).distinct()
    stars = members.where("rep <> least").select("rep", "n", "least").distinct().join(sizes, "least").where(_sizes_fit("n", "m"))
    stars = stored(stars.select(F.col("least").alias("a"), F.col("rep").alias("b")), "pairs")
    sets = _sets_of(docs, classes.select("rep", "key", "f1", "f2").join(members.select("rep").distinct(), "rep", "left_semi"))
    links = _confirm(stars, sets)
    # the smallest member may be an odd one: the centre links what is near it, before any pairs are made
    near = _open_members(_labelled(members, links), classes).where("label <> at").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()
    near = stored(near.join(stars, ["a", "b"], "left_anti"), "pairs")
    links, tried = links.union(_confirm(near, sets)), stars.union(near)
    rest = stored(_open_pairs(_open_members(_labelled(members, links), classes), sets).join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.union(_confirm(rest, sets))
    # rows that share a key are one node: it joins their classes, so numbers above all keys are never the least
    again = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    same = nodes.join(again, "key", "left_semi").join(by_set, ["f1", "f2", "n"]).where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    found = components(links.union(same))
    joined = signed.join(by_set, ["f1", "f2", "n"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("label", "rep", "key"))
    out = joined.select("key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"), F.coalesce("rep", "key").alias("class_id"))
    return out.withColumnRenamed("key", key)
