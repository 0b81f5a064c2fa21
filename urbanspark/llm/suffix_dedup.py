"""Removal of byte strings of LENGTH bytes that start more than once in the corpus.

Cover sample. In every LENGTH-byte string the GRAM-byte substring with the least hash (the leftmost of equals) marks one
position; equal strings mark the same place. These positions are the sample: about one in 70, and each suffix start has
one at a distance d of at most LENGTH - GRAM behind it. Only samples whose gram repeats (counted over the whole corpus; a
bit table of fixed size carries the answer back) can stand in a repeated string.

Suffix buckets. The suffix starts that a sample marks go with it. A bucket holds, from all documents, the samples with the
same gram (the core their strings share at the same distances). Within it the names of the whole spans around the samples
settle most ties at once: equal spans repeat at every start, a lone gram nowhere. Where a bucket has several spans, one
sample of each goes on to blocks of FINE starts and then to single starts, in the same way. So only the borders of
repeats are looked at start by start, no bucket is held in memory, and a bucket of any size is partial aggregates and
joins.

Matches never cross documents; strings are judged on the input. Edge cases: null and empty texts have no bytes; texts
shorter than LENGTH lose nothing. Repeated rows are copies of each other. Rows are told apart by key and text. Null keys
are kept. Long texts are read whole, in overlapping stretches. An empty table gives an empty result. Other columns are
not read. Keys are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, discard, stored
from .shingles import _BYTE, _power, mix, parts

LENGTH = 200
GRAM = 64
#: the largest distance of a start before its sample
FAR = LENGTH - GRAM
FINE = 8
#: bits of the table of repeated grams, whatever the corpus's size
TABLE_BITS = 1 << 27
_STRETCH = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)


def _prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(len(data))[0], out=total[1:])
    return total


def _hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = _power(len(total))[1]
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _sample(data: np.ndarray, total: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions, the first and last string start that marks each, and the grams' hashes; valid: starts of strings."""
    n = len(data)
    grams = mix((total[GRAM:] - total[:-GRAM]) * _power(n)[1][: n - GRAM + 1])
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    wide = LENGTH - GRAM + 1
    padded = np.full(-(-len(keyed) // wide) * wide, np.iinfo(np.uint64).max)
    padded[: len(keyed)] = keyed
    rows = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - LENGTH + 1
    least = np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts])
    at = np.flatnonzero(valid[:starts])
    marked = (least[at] & _PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (marked[1:] != marked[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    position = marked[first]
    return position, at[first], at[last], grams[position]


def _stretches(column: pa.Array) -> Iterator[tuple]:
    """Per group of rows or stretch of a long row: (row of each text, bytes, begin and end of each text in them, place of
    the first byte in its text, first and last start whose sample is this stretch's own)."""
    for row, data, offsets in parts(column):
        if len(offsets) == 2 and len(data) > 2 * _STRETCH:
            for own in range(0, len(data), _STRETCH):
                a, b = max(0, own - LENGTH), min(len(data), own + _STRETCH + 3 * LENGTH)
                yield row, data[a:b], np.array([0, b - a]), a, own - a, own + _STRETCH - a
        else:
            yield row, data, offsets, 0, 0, len(data)


def _sampled(column: pa.Array) -> Iterator[tuple]:
    for row, data, offsets, shift, own, own_end in _stretches(column):
        if len(data) < LENGTH:
            continue
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        end = offsets[1:][text]
        total = _prefix(data)
        place, lo, hi, gram = _sample(data, total, np.arange(len(data)) + LENGTH <= end)
        # a sample belongs to the stretch in which its first string starts
        mine = (lo >= own) & (lo < own_end)
        if own:
            mine &= lo > 0
        yield row, data, offsets, shift, text, total, place[mine], lo[mine], hi[mine], gram[mine]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for *_, gram in _sampled(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["gram"])


def _bit(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 64 - TABLE_BITS.bit_length() + 1)


def _repeated_grams(texts: DataFrame) -> np.ndarray:
    """The bit table, as bytes."""
    twice = texts.select("text").mapInArrow(_grams, "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = twice.select(_bit(F.col("gram")).alias("bit")).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    found = stored(found, "gram-bits")
    table = np.zeros((TABLE_BITS >> 15, 4096), np.uint8)
    for r in found.toLocalIterator():
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    discard(found)
    return table.ravel()


def _blocks(shared):
    """mapInArrow function (key, hash, text) -> the samples with a repeated gram and the distances they mark."""
    names = ["key", "hash", "place", "low", "high", "core", "span"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for row, data, offsets, shift, text, total, place, lo, hi, gram in _sampled(batch.column(2)):
                bit = gram >> np.uint64(64 - TABLE_BITS.bit_length() + 1)
                on = (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                place, lo, hi, gram = place[on], lo[on], hi[on], gram[on]
                owner = text[lo]
                begin, end = offsets[owner], offsets[owner + 1]
                near, far = np.maximum(0, place + LENGTH - end), np.minimum(FAR, place - begin)
                span = mix(_hash(total, np.maximum(place - FAR, begin), np.minimum(place + LENGTH, end)) + (near * LENGTH + far).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                at = pa.array(row + owner)
                columns = [pa.array(place - begin + shift), pa.array((place - hi).astype(np.int32)), pa.array((place - lo).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(span.view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *columns], names)

    return emit


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hash, text, wanted [(place, low, high)]) -> each wanted sample with the bytes around it, NULs outside the text,
    and the least and largest distance of a string that lies in the text."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column(2)[i].as_buffer().to_pybytes()
            rows = batch.column(3)[i].as_py()
            cut = []
            for r in rows:
                a = r["place"] - FAR
                cut.append((b"\0" * max(0, -a) + data[max(0, a) : r["place"] + LENGTH]).ljust(FAR + LENGTH, b"\0"))
                r["near"], r["far"] = max(0, r["place"] + LENGTH - len(data)), min(FAR, r["place"])
            same = pa.array([i] * len(rows), pa.int64())
            columns = [pa.array([r[k] for r in rows], t) for k, t in (("place", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("near", pa.int32()), ("far", pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), *columns, pa.array(cut, pa.binary())], ["key", "hash", "place", "low", "high", "near", "far", "bytes"])


def _settle(rows: DataFrame, at: list[str]) -> tuple[DataFrame, DataFrame]:
    """(byte spans of the rows that repeat at all their starts, rows to look at more closely) of rows with core and span; at: their distances.

    The latter are lone spans of shared cores, and one row of each repeated span in a core of several spans. Both are
    stored, and rows is deleted.
    """
    sets = rows.groupBy(*at, "core", "span").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "hash", "place", "low", "high")).alias("me"))
    sets = stored(sets, "span-sets")
    several = sets.groupBy(*at, "core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds")
    unsure = stored(sets.join(several, [*at, "core"], "left_semi").select(*at, "me.*"), "unsure")
    equal = stored(_removed(rows.join(sets.where("copies > 1").select(*at, "core", "span"), [*at, "core", "span"], "left_semi")), "equal")
    discard(rows, sets)
    return equal, unsure


def _removed(rows: DataFrame) -> DataFrame:
    """Byte spans of the strings at distances low to high before a sample."""
    return rows.select("key", "hash", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """key, hash, gone: each text's overlapping byte spans (start, end) to remove, of docs with key, hash, text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_repeated_grams(docs))
    rows = stored(docs.mapInArrow(_blocks(shared), "key long, hash long, place long, low int, high int, core long, span long"), "blocks")
    shared.destroy()
    equal, unsure = _settle(rows, [])
    found = [equal]
    wanted = stored(unsure.groupBy("key", "hash").agg(F.collect_list(F.struct("place", "low", "high")).alias("wanted")), "wanted")
    same = (F.col("hash") == F.col("h")) & F.col("key").eqNullSafe(F.col("k"))
    holds = bit_filter(wanted.select(F.xxhash64("key", "hash")))
    texts = docs.where(holds(F.xxhash64("key", "hash"))).join(wanted.select(F.col("key").alias("k"), F.col("hash").alias("h"), "wanted"), same)
    spans = texts.select("key", "hash", F.col("text").cast("binary").alias("text"), "wanted").mapInArrow(_spans, "key long, hash long, place long, low int, high int, near int, far int, bytes binary")
    spans = stored(spans, "spans")
    discard(unsure, wanted)

    first = F.col("part") * FINE  # distances first to first + FINE - 1
    inner = lambda low, high: {"low": F.greatest(F.col(low), first), "high": F.least(F.col(high), first + (FINE - 1))}
    fine = spans.withColumn("part", F.explode(F.sequence(F.floor(F.col("low") / FINE).cast("int"), F.floor(F.col("high") / FINE).cast("int"))))
    left = F.greatest(FAR - first - (FINE - 1), F.lit(0))
    core = F.xxhash64(F.substring("bytes", FAR - first + 1, F.lit(LENGTH - FINE + 1)))
    span = F.xxhash64(F.substring("bytes", left + 1, FAR - first + LENGTH - left), *inner("near", "far").values())
    fine = fine.select("key", "hash", "place", "part", *[c.alias(n) for n, c in inner("low", "high").items()], core.alias("core"), span.alias("span"))
    equal, unsure = _settle(stored(fine, "parts"), ["part"])
    found.append(equal)

    single = unsure.join(spans.select("key", "hash", "place", "bytes").withColumnsRenamed({"key": "k", "hash": "h", "place": "p"}), same & (F.col("place") == F.col("p")))
    single = single.select("key", "hash", "place", F.explode(F.sequence("low", "high")).alias("low"), "bytes")
    string = F.substring("bytes", FAR - F.col("low") + 1, F.lit(LENGTH))
    single = stored(single.select("key", "hash", "place", "low", F.col("low").alias("high"), F.xxhash64(string).alias("core"), F.xxhash64(string, F.lit(1)).alias("span")), "starts")
    discard(unsure, spans)
    twice = single.groupBy("low", "core", "span").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found.append(_removed(single.join(twice, ["low", "core", "span"], "left_semi")))
    out = stored(found[0].union(found[1]).union(found[2]).groupBy("key", "hash").agg(F.collect_set(F.struct("start", "end")).alias("gone")), "gone")
    discard(*found[:2], single)
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, merged = [], []
        for i in range(batch.num_rows):
            data = batch.column(1)[i].as_buffer().to_pybytes()
            out, at, spans = [], 0, []
            for s in sorted((x["start"], x["end"]) for x in batch.column(2)[i].as_py() or ()):
                if spans and s[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s[1])
                else:
                    spans.append(list(s))
            for s, e in spans:
                out.append(data[at:s])
                at = e
            out.append(data[at:])
            kept.append(b"".join(out))
            merged.append([{"start": s, "end": e} for s, e in spans])
        n = [len(batch.column(1)[i].as_buffer()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["key", "n_bytes", "spans", "kept_bytes"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row: key, n_bytes, spans (maximal removed byte runs), kept_bytes."""
    plain = F.coalesce(F.col(text), F.lit(""))
    # rows are told apart by their key; where keys repeat, by a hash of the text as well
    docs = df.select(F.col(key).cast("long").alias("key"), plain.alias("text"))
    again = stored(docs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated-keys")
    repeated = bit_filter(again.select(F.xxhash64("key")))(F.xxhash64("key"))
    docs = docs.select("key", F.when(repeated, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("hash"), "text")
    gone = repeated_spans(docs).select(F.col("key").alias("k"), F.col("hash").alias("h"), "gone")
    touched = bit_filter(gone.select(F.xxhash64("k", "h")))(F.xxhash64("key", "hash"))
    joined = docs.where(touched).join(gone, (F.col("hash") == F.col("h")) & F.col("key").eqNullSafe(F.col("k")), "left")
    whole = docs.where(~touched).withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
    both = joined.select("key", "text", "gone").union(whole.select("key", "text", "gone"))
    out = both.select("key", F.col("text").cast("binary").alias("text"), "gone").mapInArrow(_cut, "key long, n_bytes long, spans array<struct<start: long, end: long>>, kept_bytes binary")
    return out.withColumnRenamed("key", key)
