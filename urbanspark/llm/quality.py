"""Quality rules with thresholds that adapt to each language and source.

Base measures of every text are computed once, in SQL functions. For each metric a KLL quantile sketch is built per
(lang, source); the sketches merge upwards to the language and to the whole corpus, so groups with few rows borrow the
wider group's quantiles. A document is dropped when a metric lies beyond its group's outer fence (REACH times the distance
of the quartiles beyond the outer one, and never inside a fixed margin of the median), when a share lies beyond its
ceiling, or when it fails the base rule. Quartiles stay where they are until a quarter of a group is junk; ceilings hold
beyond that. Shares have no lower fence.

Sketches are partial aggregates: a hot source is combined before the shuffle. The thresholds are one row a group; Spark
broadcasts them only while they are small.

Edge cases: null and empty texts have no words, so all measures are 0 and base_failed is true. Null lang or source form
groups of their own. Texts are measured whole. Repeated rows count as often as they stand there and are all returned. An
empty table gives an empty result. Columns of the input named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: metric -> the least distance of a fence from the median
METRICS = {"word_length": 2.0, "symbol_share": 0.05, "dup_line_share": 0.3, "repeat_share": 0.1}
#: shares beyond these go in every group
CEILINGS = {"symbol_share": 0.25, "dup_line_share": 0.5, "repeat_share": MAX_REPEAT_PERCENT / 100}
#: groups with fewer rows use the wider group's sketch
MIN_GROUP = 200
REACH = 3.0
SKETCH_K = 800
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _window_hashes(w: Column) -> Column:
    return F.when(
        F.size(w) >= WINDOW,
        F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)])), F.lit(1), F.size(w) - (WINDOW - 1)),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(h: Column) -> Column:
    """Words covered by windows whose hash stands twice or more."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: F.coalesce((e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), (e["h"] == F.get(s, j + 1)["h"]), (e["h"] == F.get(s, j - 1)["h"]), F.lit(False)))
        at = F.sort_array(F.transform(twice, lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, zero, lambda a, x: F.struct((x + WINDOW).alias("end"), (a["n"] + (x + WINDOW) - F.greatest(x, a["end"])).alias("n")), lambda a: a["n"])

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, covered))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with the base measures and base_failed."""
    rest = [c for c in df.columns if c not in (*_BASE, "base_failed", "_n_lines", "_t", "_w", "_h", text)]
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return (
        df.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("_t"))
        .select(*rest, "_t", words_of(F.col("_t")).alias("_w"))
        .select(*rest, "_t", "_w", _window_hashes(F.col("_w")).alias("_h"))
        .select(
            *rest,
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            F.size(F.regexp_extract_all("_t", F.lit("[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
            let(lines(F.col("_t")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(F.col("_h")).alias("n_repeat_words"),
            F.size(lines(F.col("_t"))).cast("long").alias("_n_lines"),
        )
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def _metrics() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {"word_length": F.col("word_chars") / n, "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)), "repeat_share": F.col("n_repeat_words") / n}


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """A sketch of each metric per (lang, source), over the rows that pass the base rule."""
    passed = measured.where(~F.col("base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *[m.alias(k) for k, m in _metrics().items()])
    return passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in METRICS])


def thresholds(per_group: DataFrame) -> DataFrame:
    """Lower and upper fences per (lang, source), from the narrowest group with MIN_GROUP rows."""
    merged = [F.kll_merge_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in METRICS]
    by_lang = per_group.groupBy(F.col("lang").alias("lang2")).agg(F.sum("n").alias("n"), *merged)
    overall = by_lang.agg(F.sum("n").alias("n"), *merged)
    a, b, c = per_group.alias("a"), by_lang.alias("b"), overall.alias("c")
    wide = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang2"))).crossJoin(F.broadcast(c))  # c is one row

    def fences(k: str) -> list[Column]:
        sketch = F.when(F.col("a.n") >= MIN_GROUP, F.col(f"a.{k}")).when(F.col("b.n") >= MIN_GROUP, F.col(f"b.{k}")).otherwise(F.col(f"c.{k}"))
        low, mid, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.5, 0.75))
        outer = F.greatest(high + REACH * (high - low), mid + METRICS[k])
        if k in CEILINGS:
            return [F.least(outer, F.lit(CEILINGS[k])).alias(f"{k}_high")]
        return [F.least(low - REACH * (high - low), mid - METRICS[k]).alias(f"{k}_low"), outer.alias(f"{k}_high")]

    return wide.select(F.col("a.lang").alias("t_lang"), F.col("a.source").alias("t_source"), *[x for k in METRICS for x in fences(k)])


def filter_quality(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """df without its text, with the base measures, base_failed and kept."""
    measured = stored(measure(df, text), "quality")
    limits = stored(thresholds(sketches(measured, lang, source)), "quality-limits")
    inside = F.lit(True)
    for k, m in _metrics().items():
        within = m <= F.col(f"{k}_high")
        inside = inside & F.coalesce(within if k in CEILINGS else within & (m >= F.col(f"{k}_low")), F.lit(True))
    joined = measured.join(limits, F.col(lang).eqNullSafe(F.col("t_lang")) & F.col(source).eqNullSafe(F.col("t_source")), "left")
    rest = [c for c in measured.columns if c not in ("kept", "_n_lines")]
    return joined.select(*rest, (~F.col("base_failed") & inside).alias("kept"))
