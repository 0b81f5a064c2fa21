"""Spelling variants: words one edit apart, each led to its commonest form.

Even partitions find the pairs. A word of length l is cut into two halves; one edit leaves one of them whole, at its place
or, behind the edit, shifted by the difference of lengths. So each word is stored under its head and under its tail, and
words of the same or of one more letter probe with their heads and tails of that length. Groups over HOT rows are cut
again: their words agree outside a span, and half of the span must be whole as well. A pair is made by the left half where
that agrees, by the right half else, so it comes once, and is verified by its edit distance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, stored

#: a group with more stored words than this is cut again
HOT = 64
LETTERS = "[^A-Za-z\\u00C0-\\u00FF]+"
MIN_LENGTH, MIN_COUNT, DAMAGE = 5, 3, 97
_GROUP = ("length", "lo", "hi", "head", "tail")


def _damaged(key: Column, word: Column) -> Column:
    """word without one code point, where the hash of key and word says so."""
    hashed = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    cut = F.pmod(hashed, F.length(word).cast("long")).cast("int")
    return F.when(F.pmod(hashed, F.lit(DAMAGE)) == 0, F.concat(word.substr(F.lit(1), cut), word.substr(cut + 2, F.length(word)))).otherwise(word)


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: runs of Latin letters in lower case (A-Z only), one of DAMAGE occurrences with a letter lost, of MIN_LENGTH
    code points and MIN_COUNT occurrences at least.

    A null or empty text has no words; a null key counts as an empty one; repeated rows count each. Words are added up in
    each task before the shuffle, so a word in a third of all places is one row a task.
    """
    # the loss only shortens a word
    runs = F.filter(F.split(F.col(text), LETTERS), lambda w: F.length(w) >= MIN_LENGTH)
    found = docs.select(F.col(key).alias("key"), F.explode(F.transform(runs, ascii_lower)).alias("run"))
    words = found.select(_damaged(F.col("key"), F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _cut(rows: DataFrame) -> DataFrame:
    """Each row of a span once for either half of it: the row's group if only that half may hold the edit.

    `length` is that of the stored word; a probing word may have one letter more, in the span.
    """
    lo, hi = F.col("lo"), F.col("hi")
    middle = lo + F.floor((hi - lo) / 2).cast("int")
    halves = F.inline(F.array(F.struct(middle.alias("lo"), hi.alias("hi")), F.struct(lo.alias("lo"), middle.alias("hi"))))
    behind = F.col("hi") + F.length("word") - F.col("length") + 1
    rows = rows.select("word", "n", "side", "length", halves)
    return rows.select("*", F.col("word").substr(F.lit(1), F.col("lo")).alias("head"), F.col("word").substr(behind, F.length("word")).alias("tail"))


def _meet(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of a stored and a probing word that agree outside their group's span and are one edit apart."""
    rows = rows.join(groups, list(_GROUP), "left_semi")
    sides = [rows.where(F.col("side") == side).select(*_GROUP, F.col("word").alias(x), F.col("n").alias(f"{x}_n")) for side, x in (("stored", "a"), ("probe", "b"))]
    # words of one length probe each other
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    # a span that ends before the word is a left half: where it agrees, the pair comes from the right half's group
    inside = [F.col(x).substr(F.col("lo") + 1, F.col("hi") - F.col("lo")) for x in "ab"]
    first = (F.col("hi") == F.col("length")) | (inside[0] != inside[1])
    return sides[0].join(sides[1], list(_GROUP)).where(once & first & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """a, a_n, b, b_n: each pair of words one inserted, deleted or replaced code point apart, once.

    words has one row a word; null and empty words have no partner. Groups are counted before they are joined; one with
    more than HOT stored words is cut again, down to spans of one letter, where nearly every pair is a real one. No group
    is cut short.
    """
    words = words.select(F.col(word).alias("word"), F.col(n).alias("n")).where(F.length("word") > 0)
    roles = F.inline(F.array(*(F.struct(F.lit(side).alias("side"), (F.length("word") - less).alias("length")) for side, less in (("stored", 0), ("probe", 0), ("probe", 1)))))
    rows = _cut(words.select("word", "n", roles).withColumns({"lo": F.lit(0), "hi": F.col("length")}))
    found, old = [], []
    hot = (F.col("stored") > HOT) & (F.col("hi") - F.col("lo") > 1)
    while True:
        rows = stored(rows, "spelling-rows")
        groups = rows.groupBy(*_GROUP).agg(F.count_if(F.col("side") == "stored").alias("stored"), F.count_if(F.col("side") == "probe").alias("probes"))
        groups = stored(groups.where("stored > 0 and probes > 0 and stored + probes > 2"), "spelling-groups")
        old += [rows, groups]
        found.append(stored(_meet(rows, groups.where(~hot)), "spelling-pairs"))
        if groups.where(hot).isEmpty():
            break
        rows = _cut(rows.join(groups.where(hot), list(_GROUP), "left_semi"))
    discard(*old)
    return reduce(DataFrame.unionAll, found)


def group_variants(words: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words (one a word).

    form: the near word of largest n (ties: the first in code-point order) if that is at least 2 * n, else null. root: the
    end of the chain of forms. Counts double at each step, so the chain has log2(largest n) steps at most; each round joins
    the roots so far with themselves and doubles the reach. A null word has no near word. An empty table gives none.
    """
    words = stored(words.select(F.col(word).alias("word"), F.col(n).alias("n")), "spelling-words")
    pairs = near_pairs(words)
    ways = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = pairs.select(ways).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    better = -F.col("best.less") >= 2 * F.col("n")
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n")
    )
    known = stored(known, "spelling-forms")
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    most, reach, old = words.agg(F.max("n")).first()[0] or 0, 1, []
    while 1 << reach <= most:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        old.append(stored(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots"))
        roots, reach = old[-1], 2 * reach
    discard(*old[:-1])
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
