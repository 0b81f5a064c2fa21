"""The pipeline's stages on the small tables."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from urbanspark.llm.common import stored

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stored(stage(spark, docs, DATA), name)
        if name == "packing":
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(before)
            continue
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if name == "near_duplicates":
            assert set(after) == {i for i, (_, _, kept) in brute.near_groups(list(before.items())).items() if kept}
        if name == "decontaminate":
            assert set(after) == {r[0] for r in brute.contaminated(list(before.items()), bench) if not r[5]}
        if name == "line_dedup":
            assert all(len(t or "") <= len(before[i] or "") for i, t in after.items())
        else:
            assert all(before[i] == t for i, t in after.items())


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), name)
    assert docs.count() == 0


def test_edge_rows(spark):
    """Nulls, repeated rows, shared ids, extra columns; parts of a document stay or go together."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null and lang is not null").limit(60)
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 200").first().text
    prose = docs.orderBy(F.desc("n_chars")).limit(2).collect()
    rows = [(900_001, None, None, None, None), (900_002, "", "en", "s", 0), (900_003, " \n ", None, None, None)]
    rows += [(900_004, prose[0].text, None, None, None)] * 2 + [(900_005, item, "en", None, None), (900_005, prose[1].text + " some other words at the end", None, "s", None), (None, prose[0].text, "en", "s", 5)]
    odd = spark.createDataFrame(rows, docs.select(*corpus_pipeline.COLUMNS).schema)
    docs = docs.select(*corpus_pipeline.COLUMNS).unionByName(odd).withColumns({"key": F.lit("x"), "rep": F.lit(1), "term": F.lit(2), "sequence_id": F.lit(3)})
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), name)
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert not {900_001, 900_002, 900_003} & set(seen["language_id"])
    assert 900_004 in seen["language_id"] and seen["near_duplicates"].count(900_004) in (0, 2)
    assert 900_005 not in seen["decontaminate"]
    assert set(seen["packing"]) == set(seen["decontaminate"])
