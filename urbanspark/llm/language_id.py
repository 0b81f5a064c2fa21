"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in the executors and adds them up in a shuffle; the driver gets one row for each
language and bucket in use, once the number of languages has been checked. The log-probability matrix (buckets x
languages floats) is broadcast, and numpy scores a batch of texts at once.

Edge cases: a null text, an empty text or a text without a letter gets `und` and score 0. A table without labelled
rows learns nothing and everything is `und`. Of equally probable languages the first by name is taken. Repeated rows
count as often as they stand there, and are scored alike. An empty table gives an empty result. Texts of any length are
scored whole. Columns named like the results are
replaced; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Labelled rows to learn from, about; the sample is chosen by a hash of the row's key.
SAMPLE_ROWS = 20_000
MAX_BROADCAST_BYTES = 256 << 20
UNKNOWN = "und"
_CHUNK = 1 << 17
#: rows of a batch that are held as Python strings at once
_ROWS = 256


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets, float32


def _spans(texts: Iterable[str]) -> Iterator[tuple[list[int], str, list[int]]]:
    """Chunks of joined texts: the row of each part, the joined text, the parts' lengths.

    Two NULs follow each text; a text longer than a chunk is cut in parts that carry the next two characters along.
    """
    rows, parts, sizes, total = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text), 1), _CHUNK):
            size = min(_CHUNK, len(text) - at)
            rows.append(row)
            sizes.append(size)
            parts.append((text[at : at + size + 2] + "\0\0")[: size + 2])
            total += size
            if total >= _CHUNK:
                yield rows, "".join(parts), sizes
                rows, parts, sizes, total = [], [], [], 0
    if rows:
        yield rows, "".join(parts), sizes


def _buckets(joined: str) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each character but the last two."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes) - 2
    h = np.full(n, 0x811C9DC5, dtype=np.uint32)
    for k in range(max(ORDERS)):
        h = (h ^ codes[k : n + k]) * np.uint32(0x01000193)
        if k + 1 in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield mixed >> np.uint32(16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        lang, bucket, n = [], [], []
        for name, c in counts.items():
            used = np.flatnonzero(c)
            lang += [name] * (len(used) + 1)
            bucket.append(np.append(used, -1))
            n.append(np.append(c[used], docs[name]))
        counts.clear()
        docs.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(bucket), pa.int64()), pa.array(np.concatenate(n), pa.int64())], ["lang", "bucket", "n"])

    for batch in batches:
        frame = batch.to_pandas()
        for lang, group in frame.groupby("lang"):
            c = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            docs[lang] = docs.get(lang, 0) + len(group)
            for _, joined, sizes in _spans(map(str.lower, group["text"])):
                keep = np.ones(len(joined) - 2, bool)
                ends = np.cumsum(np.array(sizes) + 2)[:-1]
                keep[ends - 2] = keep[ends - 1] = False
                for b in _buckets(joined):
                    c += np.bincount(b[keep], minlength=BUCKETS)
            if len(counts) > 64:
                yield flush()
    if counts:
        yield flush()


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from (text, lang) of a sample of about sample_rows rows; rows with a null text or lang teach nothing."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    total, kinds = rows.agg(F.count(F.lit(1)), F.count_distinct("lang")).first()
    if kinds * BUCKETS * 4 > MAX_BROADCAST_BYTES:
        raise ValueError(f"{kinds} languages make the model larger than {MAX_BROADCAST_BYTES} bytes")
    small_batches(labelled.sparkSession)
    if total > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("k", F.lit(6)), F.lit(1_000_000)) < int(1_000_000 * sample_rows / total))
    counts = rows.select("text", "lang").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(counts["lang"].unique()))
    table, docs = np.zeros((len(langs), BUCKETS)), np.ones(len(langs))
    at = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    gram = (counts["bucket"] >= 0).to_numpy()
    table[at[gram], counts["bucket"].to_numpy()[gram]] = counts["n"].to_numpy()[gram]
    docs[at[~gram]] = counts["n"].to_numpy()[~gram]
    log_prob = np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
    return LanguageModel(langs, np.log(docs / max(docs.sum(), 1)), log_prob.astype(np.float32))


def score_texts(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language of each text and its posterior probability."""
    total = np.zeros((len(texts), len(model.langs)))
    for rows, joined, sizes in _spans(map(str.lower, texts)):
        # a part's own n-grams and the two after it, which start in the separator, alternate
        edges = np.cumsum([0, *(x for s in sizes for x in (s, 2))])[:-2]
        grams = list(_buckets(joined))
        for k in range(len(model.langs)):
            part = np.zeros(len(sizes))
            for b in grams:
                got = np.append(model.log_prob[k][b], np.float32(0))
                part += np.add.reduceat(got, np.minimum(np.append(edges, edges[-1] + sizes[-1]), len(b)), dtype=np.float64)[:-1][::2]
            part[np.array(sizes) == 0] = 0
            np.add.at(total[:, k], rows, part)
    total += model.log_prior
    total -= total.max(axis=1, keepdims=True)
    p = np.exp(total)
    return total.argmax(axis=1), p.max(axis=1) / p.sum(axis=1)


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """df with lang_pred (a learned language or `und`) and score (0 to 1)."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(text: pd.Series, letters: pd.Series) -> pd.DataFrame:
        model = shared.value
        out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0}, index=text.index)
        known = np.flatnonzero(letters.to_numpy(bool))
        if len(known) and model.langs:
            scored = [score_texts(model, text.iloc[known[a : a + _ROWS]].tolist()) for a in range(0, len(known), _ROWS)]
            out.iloc[known, 0] = np.array(model.langs, dtype=object)[np.concatenate([best for best, _ in scored])]
            out.iloc[known, 1] = np.concatenate([p for _, p in scored])
        pa.default_memory_pool().release_unused()
        return out

    letters = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    rest = [c for c in df.columns if c not in ("lang_pred", "score")]
    return df.select(*rest, predict(F.col(text), letters).alias("_lid")).select(*rest, "_lid.lang_pred", "_lid.score")
