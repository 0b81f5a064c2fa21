"""Names, numbers, times and shapes in texts."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@cache
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """From Unicode's case folding and compatibility decomposition: characters and the plain ones they become (those
    beyond the second string's end vanish), and the characters that become several."""
    one, plain, gone, several = [], [], [], {}
    for i in range(0x80, 0x30000):
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        folded = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x)).replace("đ", "d")
        folded = "".join(x if x in _PLAIN else " " for x in folded)
        if not folded:
            gone.append(c)
        elif len(folded) > 1 and folded.strip():
            several[c] = folded
        elif folded != " " * len(folded):
            one.append(c)
            plain.append(folded)
    return "".join(one + gone), "".join(plain), several


def normal_name(s: Column) -> Column:
    """Lower case, words joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(s), "[^\\p{L}\\p{N}_]+", " "))


def fold(s: Column) -> Column:
    """Case folded, without accents (compatibility decomposition), words joined by single spaces."""
    one, plain, several = _fold_table()
    spelled = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    sharp = F.replace(s, F.lit("ß"), F.lit("ss"))  # by far the most frequent of them
    apart = F.array_join(F.transform(F.split(sharp, ""), lambda c: F.coalesce(F.try_element_at(spelled, c), c)), "")
    wide = F.when(F.length(F.translate(sharp, "".join(several), "")) < F.length(sharp), apart).otherwise(sharp)
    letters = F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.lower(F.translate(wide, one, plain)))
    return F.trim(F.regexp_replace(letters, "[^a-z0-9]+", " "))


def word_set(s: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(fold(s), " "), lambda w: w != "")))


def holds_words(name: Column, words: Column) -> Column:
    return F.size(F.array_except(word_set(words), word_set(name))) == 0


def street_key(s: Column, stop: tuple[str, ...] = ("street", "road", "the")) -> Column:
    """Folded name without stop words and spaces."""
    return F.array_join(F.filter(F.split(fold(s), " "), lambda w: ~w.isin(*stop)), "")


def number(s: Column) -> Column:
    """A number with decimal comma or point, else NULL."""
    return F.regexp_replace(F.trim(s), ",", ".").try_cast("double")


def metres(s: Column) -> Column:
    """'12', '12.5 m', '12,5': the leading number."""
    return number(F.nullif(F.regexp_extract(s, "^\\s*([0-9]+(?:[.,][0-9]+)?)", 1), F.lit("")))


def tonnes(s: Column) -> Column:
    """'7.5 t' or '7.5', nothing else."""
    return number(F.nullif(F.regexp_extract(s, "^\\s*([0-9]+(?:[.,][0-9]+)?)\\s*t?\\s*$", 1), F.lit("")))


def clock_seconds(s: Column) -> Column:
    """HH:MM:SS, also past 24 hours."""
    p = F.split(s, ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")


def clock(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 3600).cast("int"), (F.floor(seconds / 60) % 60).cast("int"))


def road_refs(s: Column) -> Column:
    """'D1; E59' -> ['D1', 'E59']."""
    parts = F.transform(F.split(F.upper(s), ";"), lambda x: F.regexp_replace(x, "\\s+", ""))
    return F.filter(parts, lambda x: x.rlike("^[A-Z]+[0-9]+$"))


def shape_points(s: Column) -> Column:
    """'x,y x,y' -> array<struct<x, z>>."""
    return F.transform(F.split(F.trim(s), " +"), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("z")))


def cluster_id(ids: Column) -> Column:
    return F.concat_ws("_", F.transform(F.array_sort(ids), lambda x: x.cast("string")))


#: words that stay in lower case inside a name; fixed values
LOWER_WORDS = ("u", "i", "na", "za", "od", "do", "sa", "s", "pri", "škola", "ulica", "cesta")


def title_case(s: Column) -> Column:
    """A name written in capitals: initial capitals, also after hyphens; Roman ordinals and "OŠ" in capitals; lower-case words inside."""

    def tidy(w: Column, i: Column) -> Column:
        parts = F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "-")
        capitals = w.rlike("^[ivxlc]+\\.$") | F.regexp_replace(w, "^[()]+|[()]+$", "").isin("oš", "pš")
        return F.when(capitals, F.upper(w)).when((i > 0) & w.isin(*LOWER_WORDS), w).otherwise(parts)

    words = F.filter(F.split(F.lower(s), "\\s+"), lambda w: w != "")
    return F.when(s == F.upper(s), F.array_join(F.transform(words, tidy), " ")).otherwise(s)


def lat_lon_points(s: Column) -> Column:
    """'lat lon lat lon' -> array<struct<lat, lon>>."""
    numbers = F.transform(F.filter(F.split(s, "\\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    pairs = F.transform(numbers, lambda x, i: F.struct(x.alias("lat"), F.get(numbers, i + 1).alias("lon"), i.alias("i")))
    kept = F.filter(pairs, lambda p: (p["i"] % 2 == 0) & p["lat"].isNotNull() & p["lon"].isNotNull())
    return F.transform(kept, lambda p: F.struct(p["lat"], p["lon"]))


def junction_of(edge: Column) -> Column:
    """Junction of an internal edge ':junction_n'; a junction's id may hold underscores."""
    return F.regexp_extract(edge, "^:(.*)_[^_]*$", 1)
