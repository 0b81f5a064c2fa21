"""Benchmark decontamination with a distributed positional inverted index of the training text.

The index is a table of postings: term and place of every training token that is a test term (of all tokens, if no terms
are given). Test items become windows of WINDOW words. The lengths of the posting lists over the whole corpus rank each
window's terms; a window with a term the corpus lacks is dropped. The rarest term's list, shifted by the term's offset,
gives the places where a window may stand; there it is intersected with the lists of the window's other terms, each
shifted by its offset, from the next rarest on, until one lacks the place. A match is exact (phrase) or, with slop, a
proximity match: the rarest term at its place and all of the window's words within slop words of the window's place.

A row of the index holds the lists of one document, by place, so lists of a row meet where they are stored: only the
rarest terms' postings leave it, each with the stretch of the lists that a window reaches, to meet the windows by term.
Spark broadcasts the windows while they are under its own limit; beyond, a hot term is split like any skewed join. The
bit table of terms has a fixed size (TERM_BITS); what it lets through is dropped by the joins.

Edge cases: null and empty texts have no words. Items without words match nothing. Items shorter than WINDOW are one
window. Repeated items and repeated rows are all kept; rows that share an id are told apart. Texts are searched whole.
Empty tables on either side give no matches. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bit_filter, stored

WINDOW = 13
#: of the tables of test terms and of rarest terms
TERM_BITS = 1 << 18
_SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def terms_of(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(ascii_lower(plain))
    return F.filter(F.split(lowered, _SPLIT), lambda w: w != "")


def windows_of(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item, words: the distinct windows of each item."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(1))), lambda i: F.slice(w, i, F.least(F.lit(window), F.size(w))))
    return items.select(F.col(item).alias("item"), terms_of(F.col(text)).alias("w")).where(F.size("w") > 0).select("item", F.explode(cut(F.col("w"))).alias("words")).distinct()


def positional_index(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, key, n_words and the postings (term, pos) of every document's tokens, or of those that may be in terms."""
    words = docs.select(F.col(key), terms_of(F.col(text)).alias("w"))
    holds = bit_filter(terms.select(F.xxhash64("term")), TERM_BITS) if terms is not None else None
    posting = lambda t, i: F.struct(t.alias("term"), i.alias("pos"))
    kept = F.transform("w", posting) if holds is None else F.filter(F.transform("w", lambda t, i: F.when(holds(F.xxhash64(t)), posting(t, i))), lambda p: p.isNotNull())
    return stored(words.select(F.monotonically_increasing_id().alias("row"), key, F.size("w").cast("long").alias("n_words"), kept.alias("postings")), "postings")


def _postings(index: DataFrame) -> DataFrame:
    return index.select("row", F.explode("postings").alias("p")).select("row", "p.term", "p.pos")


def ranked_lists(windows: DataFrame, index: DataFrame) -> DataFrame:
    """window, item, size and lists (n, term, places) from the rarest term on, of windows whose words all have postings."""
    lengths = _postings(index).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = windows.select("window", F.posexplode("words").alias("place", "term")).groupBy("window", "term").agg(F.sort_array(F.collect_list("place")).alias("places"))
    known = terms.join(lengths, "term", "left").groupBy("window").agg(F.sort_array(F.collect_list(F.struct("n", "term", "places"))).alias("lists"), F.count(F.when(F.col("n").isNull(), 1)).alias("lacking"))
    return known.where("lacking = 0").join(windows, "window").select("window", "item", F.size("words").alias("size"), "lists")


def find_matches(index: DataFrame, ranked: DataFrame, width: int = WINDOW, slop: int = 0) -> DataFrame:
    """row, item, start, length, kind ('exact' or 'proximity')."""
    rarest = ranked.select("item", "size", "lists", F.col("lists")[0]["term"].alias("term"), F.col("lists")[0]["places"][0].alias("place"))
    holds = bit_filter(rarest.select(F.xxhash64("term")), TERM_BITS)
    reach = width - 1 + slop

    def anchor(p: Column, i: Column) -> Column:
        """A posting of a rarest term, with the stretch of the row's lists that its windows reach."""
        stretch = F.slice("postings", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
        return F.when(holds(F.xxhash64(p["term"])), F.struct(p["term"].alias("term"), p["pos"].alias("pos"), stretch.alias("stretch")))

    anchors = index.select("row", F.explode(F.filter(F.transform("postings", anchor), lambda p: p.isNotNull())).alias("p"))
    found = anchors.select("row", "p.*").join(rarest, "term").withColumn("start", F.col("pos") - F.col("place"))
    stands = lambda term, low, high: F.exists("stretch", lambda x: (x["pos"] >= low) & (x["pos"] <= high) & (x["term"] == term))
    exact = F.forall("lists", lambda l: F.forall(l["places"], lambda p: stands(l["term"], F.col("start") + p, F.col("start") + p)))
    near = F.forall("lists", lambda l: stands(l["term"], F.col("start") - slop, F.col("start") + F.col("size") - 1 + slop))
    kept = found.where(near).withColumn("exact", exact) if slop else found.where(exact).withColumn("exact", F.lit(True))
    return kept.select("row", "item", "start", F.col("size").alias("length"), F.when(F.col("exact"), "exact").otherwise("proximity").alias("kind"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(per document: row, key, n_words, n_hit, item_ids, matches; the index). Only exact matches count as hits."""
    windows = stored(windows_of(items, window=window).withColumn("window", F.monotonically_increasing_id()), "windows")
    index = positional_index(docs, windows.select(F.explode("words").alias("term")).distinct(), key, text)
    ranked = stored(ranked_lists(windows, index), "ranked-lists")
    found = find_matches(index, ranked, window, slop).groupBy("row").agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == "exact", F.struct("start", (F.col("start") + F.col("length")).alias("end"))))).alias("spans"),
        F.collect_set(F.when(F.col("kind") == "exact", F.col("item"))).alias("item_ids"),
        F.collect_set(F.struct("item", "start", "length", "kind")).alias("matches"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n")), lambda a: a["n"])
    out = index.select("row", key, "n_words").join(found, "row", "left")
    return out.select("row", key, "n_words", F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType)).alias("item_ids"), "matches"), index


__all__ = ["decontaminate", "find_matches", "positional_index", "ranked_lists", "terms_of", "windows_of"]
