"""Hard negatives: for each anchor and each of its nearest rows of the same label, the best rows of other labels that
score nearly as high.

Vectors are whole numbers (floor of scale * x), scores their inner products. All vectors are turned by the principal axes
of their second moments, an orthogonal rotation that leaves inner products as they are and puts most of them into the
leading components. Partial products over those, plus or minus the product of the norms of what is left and a slack for
rounding, bound the score; pairs whose bounds miss are dropped after a few components, the others verified in integers.

Anchors are taken in blocks of bounded size, each broadcast to all tasks; the table itself is never shuffled. A first look
at one row of SEED gives each anchor a floor under its best scores, so that tasks return few rows beyond the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: numbers of an anchor block that is broadcast, at 24 bytes each
BLOCK_NUMBERS = 1 << 20
SEED = 64
#: components after which bounds are tried, as shares of all
STEPS = (0.125, 0.25, 0.5)
_ROWS, _PAIRS = 1024, 1 << 16
#: whole numbers stay within this, so that products of up to 2048 components fit 64 bits
_MOST = float(1 << 26)
_FOUND = "anchor int, slot int, id long, score long"


def _whole(rows: DataFrame, scale: float, keep: Column) -> DataFrame:
    """id, label, q (whole numbers) and whether a row is an anchor, of rows with a label and a finite vector."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("vector", lambda x: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))).cast("int"))
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite).select("id", F.col("label").cast("long").alias("label"), q.alias("q"), F.coalesce(keep, F.lit(False)).alias("is_anchor"))


def _matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of width numbers, short ones filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _axes(rows: DataFrame, width: int) -> np.ndarray:
    """Columns: the principal axes of all vectors about zero, the largest first. Driver work: one width x width matrix."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            q = _matrix(b.column(0), width).astype(float)
            total += q.T @ q
        yield pa.RecordBatch.from_pydict({"i": np.arange(width, dtype=np.int32), "row": list(total)}, schema=pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))]))

    def added(table: pa.Table) -> pa.Table:
        return pa.table({"i": table["i"][:1], "row": [np.stack(table["row"].to_numpy()).sum(0)]})

    parts = rows.select("q").mapInArrow(moments, "i int, row array<double>")
    total = np.zeros((width, width))
    for r in parts.groupBy("i").applyInArrow(added, "i int, row array<double>").collect():
        total[r.i] = r.row
    _, axes = np.linalg.eigh((total + total.T) / 2)
    return axes[:, ::-1].copy()


class _Side:
    """Vectors with what bounds their products: rotated components and the norms of what comes after each step."""

    def __init__(self, q: np.ndarray, axes: np.ndarray, ends: list[int]):
        self.q, self.turned = q, q @ axes
        squares = self.turned**2
        self.rest = np.stack([np.sqrt(squares[:, e:].sum(1)) for e in ends])
        self.norm = np.sqrt(squares.sum(1))


class _Best:
    """The best n (score, id) of each anchor and slot, and the score below which nothing matters."""

    def __init__(self, low: np.ndarray, n: int):
        self.low, self.n = low.copy(), n
        self.found = np.zeros((0, 4), np.int64)
        self.waiting: list[np.ndarray] = []

    def add(self, anchor: np.ndarray, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.waiting.append(np.stack([anchor, slot, ids, score], 1))
        if sum(map(len, self.waiting)) > max(_PAIRS, len(self.found)):
            self.settle()

    def settle(self) -> np.ndarray:
        rows = np.concatenate([self.found, *self.waiting])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], rows[:, 1], rows[:, 0]))]
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)][: len(rows)]
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        self.found, self.waiting = rows[place < self.n], []
        last = rows[place == self.n - 1]
        self.low[last[:, 0], last[:, 1]] = np.maximum(self.low[last[:, 0], last[:, 1]], last[:, 3])
        return self.found


def _search(rows: DataFrame, block: dict, low: np.ndarray, high: np.ndarray, same: bool, n: int) -> DataFrame:
    """anchor, slot, id, score: what each task finds best of its rows for each anchor and slot, scores within [low, high].

    same: rows of the anchor's label but not of its id, or rows of other labels.
    """
    width = block["axes"].shape[0]
    ends = sorted({max(1, round(width * s)) for s in STEPS})
    data = {k: block[k] for k in ("ids", "labels", "q", "axes")}
    shared = rows.sparkSession.sparkContext.broadcast(data | {"low": low, "high": high})
    block["shared"].append(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        anchors, best = _Side(b["q"], b["axes"], ends), _Best(b["low"], n)
        highest = b["high"].max(1).astype(float)
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                # a null id comes after all others
                ids, labels = part.column(0).fill_null(2**63 - 1).to_numpy(), part.column(1).to_numpy()
                side = _Side(_matrix(part.column(2), width), b["axes"], ends)
                for a in range(0, len(b["ids"]), _ROWS):
                    _tile(b, anchors, best, highest, slice(a, a + _ROWS), ids, labels, side)
        out = best.settle()
        yield pa.RecordBatch.from_pydict(dict(zip(("anchor", "slot", "id", "score"), (out[:, 0].astype(np.int32), out[:, 1].astype(np.int32), out[:, 2], out[:, 3]), strict=True)))

    def _tile(b: dict, anchors: _Side, best: _Best, highest: np.ndarray, a: slice, ids: np.ndarray, labels: np.ndarray, side: _Side) -> None:
        lowest = best.low[a].min(1).astype(float)
        partial = side.turned[:, : ends[0]] @ anchors.turned[a, : ends[0]].T
        slack = 1 + 1e-9 * np.outer(side.norm, anchors.norm[a])
        reach = np.outer(side.rest[0], anchors.rest[0, a]) + slack
        alike = labels[:, None] == b["labels"][None, a]
        wanted = alike & (ids[:, None] != b["ids"][None, a]) if same else ~alike
        r, c = np.nonzero(wanted & (partial + reach >= lowest) & (partial - reach <= highest[a]))
        partial, slack, c = partial[r, c], slack[r, c], c + a.start
        for k in range(0, len(r), _PAIRS):
            _verify(b, anchors, best, highest, ids, side, r[k : k + _PAIRS], c[k : k + _PAIRS], partial[k : k + _PAIRS], slack[k : k + _PAIRS])

    def _verify(b: dict, anchors: _Side, best: _Best, highest: np.ndarray, ids: np.ndarray, side: _Side, r: np.ndarray, c: np.ndarray, partial: np.ndarray, slack: np.ndarray) -> None:
        for step in range(1, len(ends)):
            span = slice(ends[step - 1], ends[step])
            partial = partial + np.einsum("ij,ij->i", side.turned[r, span], anchors.turned[c, span])
            reach = side.rest[step, r] * anchors.rest[step, c] + slack
            keep = (partial + reach >= best.low[c].min(1)) & (partial - reach <= highest[c])
            r, c, partial, slack = r[keep], c[keep], partial[keep], slack[keep]
        score = np.einsum("ij,ij->i", side.q[r], anchors.q[c])
        hit, slot = np.nonzero((score[:, None] >= best.low[c]) & (score[:, None] <= b["high"][c]))
        if len(hit):
            best.add(c[hit], slot, ids[r[hit]], score[hit])

    return rows.select("id", "label", "q").mapInArrow(run, _FOUND)


def _first(found: DataFrame, n: int) -> DataFrame:
    """The first n of each anchor and slot, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _floors(seeds: DataFrame, block: dict, low: np.ndarray, high: np.ndarray, same: bool, n: int) -> np.ndarray:
    """low, raised to the n-th best score among some of the rows: no row below it can be among the best n of all."""
    out = low.copy()
    for r in _first(_search(seeds, block, low, high, same, n), n).where(F.col("rank") == n).collect():
        out[r.anchor, r.slot] = max(out[r.anchor, r.slot], r.score)
    return out


def _mine_block(spark: SparkSession, rows: DataFrame, anchors: pa.Table, axes: np.ndarray, n_pos: int, n_neg: int, low: int, high: int) -> DataFrame:
    width = len(axes)
    block = {"ids": anchors["id"].to_numpy(), "labels": anchors["label"].to_numpy(), "q": _matrix(anchors["q"], width), "axes": axes, "shared": []}
    seeds = rows.where(F.pmod(F.xxhash64("id"), F.lit(SEED)) == 0)
    least, most = np.full((len(anchors), 1), -(2**62)), np.full((len(anchors), 1), 2**62)
    floors = _floors(seeds, block, least, most, True, n_pos)
    positives = _first(_search(rows, block, floors, most, True, n_pos), n_pos).toArrow()
    anchor, slot, score = positives["anchor"].to_numpy(), positives["rank"].to_numpy() - 1, positives["score"].to_numpy()
    # a positive that is missing allows no score
    least, most = np.full((len(anchors), n_pos), 2**62), np.full((len(anchors), n_pos), -(2**62))
    least[anchor, slot], most[anchor, slot] = -(-low * score // high), score
    floors = _floors(seeds, block, least, most, False, n_neg)
    found = _first(_search(rows, block, floors, most, False, n_neg), n_neg)
    names = pa.table({"anchor": positives["anchor"], "slot": pa.array(slot, pa.int32()), "anchor_id": block["ids"][anchor], "positive_id": positives["id"], "positive_score": positives["score"]})
    known = lambda name: F.when(F.col(name) != 2**63 - 1, F.col(name)).alias(name)
    out = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(spark.createDataFrame(names), ["anchor", "slot"])
    out = stored(out.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score"), "negatives")
    for shared in block["shared"]:
        shared.destroy()
    return out


def mine(rows: DataFrame, is_anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "vector", n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), held within 2^26 on either side; shorter vectors are filled up with zeros. An
    anchor's positives are its first n_positives other rows of its label, its negatives for each the first n_negatives rows
    of other labels with low * positive <= high * negative <= high * positive; the higher score first, then the smaller id.
    Ids and labels are whole numbers. Rows with a null label, vector or component, or one that is not finite, take no part;
    a row with a null id comes last among equals and is no anchor. Rows that repeat an id count each, but not as positives
    of an anchor with that id; an anchor that repeats with all its values counts once. Tables without anchors, or with one
    label only, give no rows. Only the three columns named are read.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"), is_anchor.alias("keep"))
    table = stored(_whole(rows, scale, F.col("keep")), "whole-vectors")
    sizes = table.agg(F.max(F.size("q")).alias("width"), F.count_if("is_anchor").alias("anchors")).first()
    axes = _axes(table, max(1, sizes.width or 1))
    n_blocks = 1 + sizes.anchors * len(axes) // BLOCK_NUMBERS
    anchors = table.where("is_anchor").select("id", "label", "q").distinct().withColumn("block", F.pmod(F.xxhash64("id", "label", "q"), F.lit(n_blocks)))
    anchors, out = stored(anchors, "anchors"), []
    for i in range(n_blocks):
        block = anchors.where(F.col("block") == i).toArrow()
        if len(block):
            out.append(_mine_block(spark, table, block, axes, n_positives, n_negatives, low, high))
    discard(table, anchors)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionAll, out) if out else empty
