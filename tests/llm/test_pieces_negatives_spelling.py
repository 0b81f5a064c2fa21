"""Operators 11 to 13 against the library and brute force."""

import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from urbanspark.llm import hard_negatives, pieces, queries, spelling

DATA = "/root/testdata/sf0.001"
MODEL = queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return pieces.piece_encoder(MODEL)


def same_ids(encoder, texts):
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == encoder.processor.encode(text or ""), text[:80]


@pytest.mark.parametrize("alphabet", ["the anigro", "aeth  n\n\té▁ß梦😀\0=12Ａ", "ab", " \n", "".join(map(chr, range(0x1F300, 0x1F340)))])
def test_ids_of_random_texts(encoder, alphabet):
    rng = random.Random(len(alphabet))
    same_ids(encoder, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(1500)])


def test_ids_of_long_rows(encoder):
    same_ids(encoder, [" " * n + end for n in (*range(120, 260), 5000) for end in ("", "a", "the", "\n", "😀")])
    rng = random.Random(2)
    same_ids(encoder, ["".join(rng.choice("abcdefghijklmnop") for _ in range(20_000)), "ab" * 100_000, "=" * 99_999, "the " * 100_000])


def test_cache_is_emptied(encoder, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 50)
    monkeypatch.setattr(pieces, "_PART_CHARS", 300)
    rng = random.Random(3)
    same_ids(encoder, [" ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(20)) for _ in range(40)])


def test_piece_query(spark):
    sp, docs = SentencePieceProcessor(model_file=MODEL), spark.read.parquet(f"{DATA}/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {r.doc_id: sp.encode(r.text or "") for r in docs}
    want = {i: (len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for i, x in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_sentencepiece(spark, DATA).collect()} == want


def test_piece_edges(spark):
    schema = "doc_id long, text string, ids string, decoded int"
    rows = [(1, None, "x", 1), (None, "", "x", 1), (2, "same text", "x", 1), (2, "same text", "x", 1)]
    out = pieces.encode_pieces(spark.createDataFrame(rows, schema), MODEL).collect()
    assert sorted((str(r.doc_id), len(r.ids), r.decoded) for r in out) == [("1", 0, ""), ("2", 2, "same text"), ("2", 2, "same text"), ("None", 0, "")]
    assert pieces.encode_pieces(spark.createDataFrame([], schema), MODEL).count() == 0


VECTORS = "vec_id long, label int, vector array<float>"


def mined(spark, rows):
    out = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 4 == 0).collect()
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out), key=str)


def brute_negatives(rows):
    return brute.negatives([(i, y, v, i is not None and i % 4 == 0) for i, y, v in rows])


@pytest.mark.parametrize("numbers, seed", [(1 << 20, 64), (64, 2)])
def test_negatives(spark, monkeypatch, numbers, seed):
    """Blocks of few anchors and many seeds too; vectors about one direction, with ties and a large group of copies."""
    monkeypatch.setattr(hard_negatives, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(hard_negatives, "SEED", seed)
    rng = random.Random(5)
    f32 = lambda v: [float(x) / 64 for x in v]
    rows = [(i, rng.randint(0, 2), f32([rng.randint(20, 40), *(rng.randint(-9, 9) for _ in range(11))])) for i in range(120)]
    rows += [(200 + i, i % 3, f32([30, 5] + [0] * 10)) for i in range(60)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (None, 1, [1.0, 0.25]), (1, 1, [0.5]), (2, 2, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (None, 3, [1.0]), (3, 2, [-1.0, 0.0])]
    rows += [(4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [1.0, None]), (7, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, []), (12, 7, [-1.0, -1.0]), (13, 7, [1.0, 1.0]), (16, 5, [0.0, 0.0]), (17, 5, [0.0, 0.0])]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == []
    assert mined(spark, [(4, 1, [1.0]), (5, 1, [1.0])]) == []


def grouped(spark, counts):
    out = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert len(out) == len(counts)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}


@pytest.mark.parametrize("hot", [64, 1])
def test_spelling_of_random_words(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    rng = random.Random(hot)
    words = {"".join(rng.choice("abß😀") for _ in range(rng.randint(1, 7))) for _ in range(500)} | {"house" * 4, "house" * 4 + "s", "hause" + "house" * 3, "ouse" + "house" * 3}
    counts = {w: rng.choice([3, 3, 6, 7, 12, 24, 49]) for w in words}
    assert grouped(spark, counts) == brute.spelling_variants(counts)


def test_spelling_chain_and_ties(spark):
    chain = {"a" * (5 + k): 3 << k for k in range(12)}
    assert {v[1] for v in grouped(spark, chain).values()} == {"a" * 16}
    assert grouped(spark, {"house": 3, "mouse": 9, "rouse": 9})["house"] == ("mouse", "mouse", 3, 2, 9)


def test_spelling_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = brute.spelling_variants(brute.spelling_counts(docs))
    out = queries.op13_spelling_variants(spark, DATA).collect()
    assert len(out) == len(want)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == want


def test_spelling_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "Straßen STRASSEN strassen " * 40, 0), (3, "Ünder ünder " * 9, 0), (3, "Ünder ünder " * 9, 0), (4, "x" * 100_000 + " kurz", 0)]
    counts = spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string, word int"))
    assert {r.word: r.n for r in counts.collect()} == brute.spelling_counts([(i, t) for i, t, _ in rows])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(spelling.count_words(empty)).count() == 0
