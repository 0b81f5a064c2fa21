"""Best-fit packing by bin completion.

A document's ids are cut into pieces of at most CAPACITY tokens. Pieces of one length are interchangeable, so the packing
is planned on the number of pieces of each length: CAPACITY numbers, whatever the corpus's size. Around the largest piece
left, the fillings of the remaining room are enumerated, largest piece first; a filling is dominated, and dropped, if one
of its pieces or a pair of them could give way to a single larger piece that is left. Best-fit solutions are the
incumbents: the first one takes the fullest filling each time and uses it as often as the counts allow. If it takes more
sequences than a lower bound (by tokens, and by pieces over half a sequence), the search branches over the undominated fillings, and a branch whose sequences
so far and whose waste bound reach the incumbent is cut. A branch takes a filling as often as the counts allow; a second
search takes fillings once as well. If that proves nothing, the histogram is divided by factors, and the patterns of the
smaller plan are repeated. NODES bounds the work on one filling, WIDTH the fillings of a branch and BRANCHES the steps of
a search, at every size: beyond, the incumbent stands and every piece is packed all the same. The column `proven` says
whether the plan meets that bound or a search tried all undominated fillings. Spark
ranks the pieces of each length in salted groups, as many as the most frequent length needs, and looks each rank up.

Edge cases: null and empty texts are one end id. Repeated rows are packed as often as they stand there; null keys too.
Texts of any length are cut whole. An empty table gives an empty result. Other columns are not read. Keys are cast to long.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder

CAPACITY = 2048
#: branches tried for one filling before the incumbent is taken
NODES = 4000
#: steps of the search over sequences beyond the first incumbent
BRANCHES = 300
#: fillings tried for one largest piece
WIDTH = 6
#: pieces of one length that one task ranks, about
RANKED = 500_000


def dominated(filling: dict[int, int], room: int, counts: np.ndarray, lengths: list[int]) -> bool:
    """Whether a piece of the filling, or two of them, could give way to one larger piece that is left."""
    slack = room - sum(x * n for x, n in filling.items())
    own = sorted(filling)
    sums = {(x,) for x in own} | {(x, y) for x in own for y in own if x < y or (x == y and filling[x] > 1)}
    for parts in sums:
        least = sum(parts) + (len(parts) == 1)
        i = bisect_left(lengths, least)
        while i < len(lengths) and lengths[i] <= sum(parts) + slack:
            if counts[lengths[i]] > filling.get(lengths[i], 0):
                return True
            i += 1
    return False


def completions(room: int, counts: np.ndarray, lengths: list[int], width: int = 1, nodes: int = NODES) -> tuple[list[dict[int, int]], bool]:
    """Up to width undominated fillings of room, the fullest first, and whether there are no others; lengths: ascending, with a count."""
    found: list[tuple[int, int, dict[int, int]]] = []
    stack: list[tuple[int, int]] = []  # (length, how many) chosen so far
    left = nodes

    def worst() -> int:
        return found[-1][0] if len(found) == width else -1

    def search(room_left: int, below: int, filled: int) -> bool:
        nonlocal left
        if filled > worst():
            filling = dict(stack)
            if not found or not dominated(filling, room, counts, lengths):
                found.append((filled, -len(found), filling))
                found.sort(key=lambda f: (-f[0], -f[1]))
                del found[width:]
        i = bisect_right(lengths, min(room_left, below)) - 1
        while i >= 0 and left > 0:
            x = lengths[i]
            # waste bound: what this and all smaller lengths can still add
            if filled + min(room_left, reach[i]) <= worst():
                return False
            for n in range(min(int(counts[x]), room_left // x), 0, -1):
                left -= 1
                stack.append((x, n))
                done = search(room_left - n * x, x - 1, filled + n * x)
                stack.pop()
                if done or worst() == room:
                    return True
                if left <= 0:
                    return False
            i -= 1
        return False

    reach = np.cumsum([x * int(counts[x]) for x in lengths]).tolist()
    search(room, room, 0)
    return [f for _, _, f in found], left > 0 and len(found) < width


def _branch(counts: np.ndarray, lengths: list[int], capacity: int, width: int) -> tuple[list[tuple[int, dict[int, int]]], bool]:
    """The fillings around the largest piece left, with how often the counts allow each, and whether there are no others."""
    top = lengths[-1]
    counts[top] -= 1
    found, all_of_them = completions(capacity - top, counts, lengths if counts[top] else lengths[:-1], width)
    counts[top] += 1
    out = []
    for filling in found:
        filling[top] = filling.get(top, 0) + 1
        out.append((min(int(counts[x]) // n for x, n in filling.items()), filling))
    return out, all_of_them


def least_sequences(histogram: dict[int, int], capacity: int) -> int:
    """A bound under every plan: for each k, pieces over half a sequence stand in sequences of their own, and pieces from k to
    half a sequence fill what those of at most capacity - k leave, or more sequences."""
    counts = np.zeros(capacity + 2, np.int64)
    for x, n in histogram.items():
        counts[x] = n
    many, tokens = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 2))
    half, k = capacity // 2, np.arange(1, capacity // 2 + 1)
    large = many[capacity] - many[half]
    room = capacity * (many[capacity - k] - many[half]) - (tokens[capacity - k] - tokens[half])
    over = np.maximum(tokens[half] - tokens[k - 1] - room, 0)
    return int(max(large + (-(-over // capacity)).max(initial=0), -(-int(tokens[capacity]) // capacity)))


def _plan(histogram: dict[int, int], capacity: int, whole_tree: bool = True) -> tuple[list[tuple[int, dict[int, int]]], bool]:
    """The best-fit plan, or what the searches (that over whole patterns only, and shorter, without whole_tree) find beyond it;
    whether it is proven."""
    counts = np.zeros(capacity + 1, np.int64)
    for x, n in histogram.items():
        counts[x] = n
    total = int((counts * np.arange(capacity + 1)).sum())
    best: list[tuple[int, dict[int, int]]] | None = None
    fewest, every = 0, True

    def dive(counts: np.ndarray, done: list[tuple[int, dict[int, int]]]) -> list[tuple[int, dict[int, int]]]:
        """The best-fit solution from here on."""
        counts, done = counts.copy(), list(done)
        lengths = [int(x) for x in np.flatnonzero(counts)]
        while lengths:
            (n, filling), *_ = _branch(counts, lengths, capacity, 1)[0]
            for x, k in filling.items():
                counts[x] -= n * k
            done.append((n, filling))
            if any(counts[x] == 0 for x in filling):
                lengths = [x for x in lengths if counts[x]]
        return done

    def steps(counts: np.ndarray, rest: int, used: int, single: bool) -> Iterator[tuple]:
        """The branches worth trying: counts, rest and sequences after, and the move. A filling is used as often as the counts
        allow, and once too if single."""
        nonlocal every
        branches, all_of_them = _branch(counts, [int(x) for x in np.flatnonzero(counts)], capacity, WIDTH)
        every = every and all_of_them
        for n, filling in branches:
            size = sum(x * k for x, k in filling.items())
            for times in (n, 1) if single and n > 1 else (n,):
                if used + times + -(-(rest - times * size) // capacity) < fewest:
                    after = counts.copy()
                    for x, k in filling.items():
                        after[x] -= times * k
                    yield after, rest - times * size, used + times, (times, filling)

    def search(single: bool, left: int) -> bool:
        """Depth first, left steps at most; False when that ended it."""
        nonlocal best, fewest
        open_steps, moves = [steps(counts, total, 0, single)], []
        while open_steps:
            step = next(open_steps[-1], None)
            if step is None:
                open_steps.pop()
                moves = moves[: len(open_steps) - 1] if open_steps else []
                continue
            if left <= 0:
                return False
            left -= 1
            after, rest, used, move = step
            moves = [*moves[: len(open_steps) - 1], move]
            if rest:
                open_steps.append(steps(after, rest, used, single))
            else:
                best, fewest = moves, used
        return True

    best = dive(counts, [])
    fewest, least, whole = sum(n for n, _ in best), least_sequences(histogram, capacity), False
    # whole patterns first: their tree is as deep as there are lengths, however often each length stands there
    for single in (False, True)[: 1 + whole_tree]:
        if fewest > least:
            every = True
            whole = search(single, BRANCHES if whole_tree else BRANCHES // 10) and every and single
    return best, whole or fewest == least


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, dict[int, int]]], bool]:
    """([(sequences, {length: pieces in each})] that use every piece of the histogram once; whether no plan has fewer).

    Where the plan for the histogram itself is not proven, the histogram is divided by factors (what its counts have in
    common, and powers of two that keep nine tenths of the tokens), the smaller one is planned, its patterns repeated, and what is left over planned too.
    """
    histogram = {x: n for x, n in histogram.items() if n}
    best, proven = _plan(histogram, capacity)
    fewest, least, total = sum(n for n, _ in best), least_sequences(histogram, capacity), sum(x * n for x, n in histogram.items())
    most = max(histogram.values(), default=0)
    for factor in dict.fromkeys([math.gcd(*histogram.values()), *(1 << k for k in range(most.bit_length() - 1, 0, -1))]):
        part = {x: n // factor for x, n in histogram.items() if n >= factor}
        if proven or factor < 2 or 10 * factor * sum(x * n for x, n in part.items()) < 9 * total:
            continue
        rest = {x: n % factor for x, n in histogram.items() if n % factor}
        found = [(factor * n, filling) for n, filling in _plan(part, capacity, False)[0]] + _plan(rest, capacity, False)[0]
        if (used := sum(n for n, _ in found)) < fewest:
            best, fewest, proven = found, used, used == least
    return best, proven


def _runs(bins: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each pattern and length: ranks from `rank` on go to `each` places a bin, from bin `first` and `offset` on."""
    rows, used, sequence = [], dict.fromkeys(range(capacity + 1), 0), 0
    for n, filling in bins:
        offset = 0
        for x in sorted(filling, reverse=True):
            rows.append((x, used[x], filling[x], sequence, offset))
            used[x] += n * filling[x]
            offset += x * filling[x]
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "first", "offset"), table.T, strict=True))


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for k, ids in zip(part.column(0).to_pylist(), encoder(tokenizer).encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    size = len(ids) // 4
                    rows += [(k, p, s, min(capacity, size - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for p, s in enumerate(range(0, size, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["key", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(cut, "key long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (a stored table with key, piece, length) with sequence_id, offset and proven."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    bins, proven = plan(histogram, capacity)
    runs = spark.sparkContext.broadcast(_runs(bins, capacity))
    groups = -(-max(histogram.values(), default=1) // RANKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece", "ids_crc32", F.monotonically_increasing_id() % 1024), F.lit(16 * groups)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "piece", "start", "ids_crc32")) - 1).join(before, ["length", "salt"])

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = runs.value
        wide = np.int64(1) << 44
        at = np.searchsorted(r["length"] * wide + r["rank"], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        nth = rank.to_numpy() - r["rank"][at]
        return pd.DataFrame({"sequence_id": r["first"][at] + nth // r["each"][at], "offset": r["offset"][at] + nth % r["each"][at] * length.to_numpy()})

    return ranked.withColumn("_at", find("length", F.col("rank") + F.col("before"))).select("key", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset", F.lit(proven).alias("proven"))


def pack(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset, proven."""
    return place(stored(pieces_of(docs, tokenizer, end_id, key, text, capacity), "pieces"), capacity).withColumnRenamed("key", key)
