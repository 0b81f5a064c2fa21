"""Removal of multi-line chunks that repeat anywhere in the corpus.

Each line with a word is hashed; a rolling hash over ROLL of them chooses where a chunk starts, so an inserted or deleted
line moves only the boundaries next to it. A chunk runs to the next start, and over at least MIN_LINES lines with a word,
so that it may share its last line with the next chunk. Chunks are counted by hash over the whole corpus (a partial
aggregate); only chunks with a repeated hash carry their text on, and they are grouped and joined by their bytes, so a
hash collision removes nothing. The first copy by (key, place) stays. Of every later copy the chunk goes, and with it the
lines on either side, up to REACH lines with a word, that equal those beside the first copy, byte for byte: so a passage
goes up to its ends, though its ends are no chunk ends. Each line that goes has an equal one at a smaller (key, place).

Edge cases: a null text stays null, an empty one empty. A text that loses no chunk comes back unchanged to the byte.
A single line is never removed by itself; blank lines go inside and beside repeated lines only. Rows that share a key
count as one document. Null keys sort first. Long texts are cut whole, in time that grows with their lines. An empty
table gives an empty result. Extra columns stay; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, let, stored

ROLL = 2
#: a chunk starts at a line with a chance of STARTS in DIVISOR
STARTS, DIVISOR = 3, 4
MIN_LINES = 2
#: lines with a word on either side of a chunk that are compared with those beside its first copy
REACH = 3
#: of the tables that keep unrepeated chunks and untouched documents out of the shuffles
TABLE_BITS = 1 << 21
_HAS_WORD = "[^\\x20\\x09-\\x0D]"


def chunks_of(text: Column) -> Column:
    """array<struct<start, n, body, before, after>>: the text's chunks; start and n count all lines, from 0."""

    def cut(lines: Column) -> Column:
        worded = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_HAS_WORD), F.struct(i.alias("i"), F.xxhash64(x).alias("h")))), lambda w: w.isNotNull())
        return let(worded, lambda w: let(starts(w), lambda s: F.transform(s, lambda a, j: chunk(lines, w, a, F.get(s, j + 1)))))

    def starts(w: Column) -> Column:
        rolled = lambda i: F.xxhash64(*[F.get(w, i + k)["h"] for k in range(ROLL)])
        begins = lambda i: (i == 0) | (F.pmod(rolled(i), F.lit(DIVISOR)) < STARTS)
        return F.filter(F.transform(w, lambda _, i: F.when((i <= F.size(w) - MIN_LINES) & begins(i), i)), lambda i: i.isNotNull())

    def chunk(lines: Column, w: Column, a: Column, following: Column) -> Column:
        last = F.greatest(F.coalesce(following - 1, F.size(w) - 1), a + (MIN_LINES - 1))
        place = lambda i: F.get(w, i)["i"]
        start, end = place(a), place(last) + 1
        low = F.when(a > REACH, place(a - REACH)).otherwise(0)
        high = F.coalesce(place(last + REACH) + 1, F.size(lines))
        return F.struct(
            start.alias("start"),
            (end - start).alias("n"),
            F.array_join(F.slice(lines, start + 1, end - start), "\n").alias("body"),
            F.slice(lines, low + 1, start - low).alias("before"),
            F.slice(lines, end + 1, high - end).alias("after"),
        )

    return let(F.split(text, "\n"), cut)


def _alike(a: Column, b: Column) -> Column:
    """How many of the first lines are equal."""
    return let(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda z: let(F.array_position(z, False).cast("int"), lambda p: F.when(p == 0, F.size(z)).otherwise(p - 1)))


def repeated_chunks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, print (hash of the text) and the lines low to high - 1 that go with each repeated chunk."""
    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), F.col(text).alias("t")).where("t is not null")
    cut = rows.select("key", "print", F.explode(chunks_of(F.col("t"))).alias("c")).select("key", "print", "c.*", F.xxhash64("c.body").alias("hash"))
    twice = stored(cut.groupBy("hash").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("hash"), "chunk-hashes")
    copies = stored(cut.where(bit_filter(twice, TABLE_BITS)(F.col("hash"))).join(twice, "hash", "left_semi"), "chunk-copies")
    first = copies.groupBy("hash", "body").agg(F.min(F.struct("key", "start", "before", "after")).alias("first"), F.count(F.lit(1)).alias("count")).where("count > 1")
    # as a table of its own, so that a hot chunk's copies can be split in the join
    later = copies.join(stored(first, "chunk-firsts"), ["hash", "body"]).where(~F.struct("key", "start").eqNullSafe(F.struct("first.key", "first.start")))
    back = _alike(F.reverse("before"), F.reverse("first.before"))
    ahead = _alike(F.col("after"), F.col("first.after"))
    return later.select("key", "print", (F.col("start") - back).alias("low"), (F.col("start") + F.col("n") + ahead).alias("high"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the repeated chunks cut from its text, n_removed_lines and n_removed_chunks."""
    gone = repeated_chunks(df, key, text).groupBy(F.col("key").alias("_key"), F.col("print").alias("_print")).agg(F.collect_set(F.struct("low", "high")).alias("_gone"))
    gone = stored(gone, "chunks-gone")
    rest = [c for c in df.columns if c not in ("n_removed_lines", "n_removed_chunks", "_key", "_print", "_gone", "_cut")]
    touched = bit_filter(gone.select(F.xxhash64("_key")), TABLE_BITS)(F.xxhash64(F.col(key)))
    joined = df.select(*rest).where(touched).join(gone, F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(text) == F.col("_print")), "left")
    places = F.flatten(F.transform("_gone", lambda g: F.sequence(g["low"], g["high"] - 1)))

    def left(lines: Column) -> Column:
        kept = lambda k: F.struct((F.size(lines) - F.size(k)).cast("long").alias("n"), F.array_join(F.transform(k, lambda i: F.get(lines, i)), "\n").alias("text"))
        return let(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), kept)

    cut = joined.withColumn("_cut", F.when(F.col("_gone").isNotNull(), let(F.split(F.col(text), "\n"), left)))
    zero = F.lit(0).cast("long")
    new = F.when(F.col("_cut").isNull(), F.col(text)).otherwise(F.col("_cut.text"))
    n_lines, n_chunks = F.coalesce("_cut.n", zero), F.when(F.col("_gone").isNull(), zero).otherwise(F.size("_gone").cast("long"))
    changed = cut.select(*[new.alias(c) if c == text else F.col(c) for c in rest], n_lines.alias("n_removed_lines"), n_chunks.alias("n_removed_chunks"))
    return changed.union(df.select(*rest, zero, zero).where(~touched))
