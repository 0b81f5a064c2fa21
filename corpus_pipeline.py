"""From raw documents to packed training sequences: five stages, each by one operator of urbanspark.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Columns of documents: doc_id,
text, lang, source, n_chars. run() writes each stage's result as Parquet to the shared folder and reads it back.

doc_id names a document: rows that share one are parts of it, and near_duplicates and decontaminate keep or drop them
together (a clean row goes with a bad one of its id; repeated rows stay together). A null doc_id is one such name for
decontaminate, and never a duplicate. A null or blank text has no language and goes in the first stage; other columns may
be null. Ties between near duplicates go to the smallest doc_id. Columns beyond those of documents are dropped, whatever
their names. Texts are worked on whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.llm import decontaminate, language_id, line_dedup, minhash, packing
from urbanspark.llm.common import read, stored
from urbanspark.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: documents whose best language is less probable than this are rejected, and those without a letter
MIN_LANGUAGE_SCORE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language."""
    out = language_id.identify(docs.select(*COLUMNS), language_id.train(docs))
    return out.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated multi-line chunks; a document that loses all its words goes."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed_chunks") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return out.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates."""
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of whose words a twentieth or more stand in benchmark passages."""
    found, _ = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    bad = found.where("n_hit > 0 and 20 * n_hit >= n_words").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.select(*COLUMNS).join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as can be."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=0)


STAGES = [("language_id", languages), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontaminate", benchmark), ("packing", packed)]

#: language ID and packing are beyond SQL; the stages are tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
