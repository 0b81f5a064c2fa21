"""Cases of the whole job that a review found cut."""

import random

import brute
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from urbanspark.llm import chat, quality, toxicity


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 6))) for _ in range(n))


def test_quality_drops_junk_that_is_common_in_its_source(spark):
    rng = random.Random(4)
    spam = lambda: " ".join(w + "$#" for w in prose(rng, 60).split(" "))
    lines = lambda: "\n".join(f"{prose(rng, 4)}\n{same}" for same in ["home news shop help"] * 10)
    rows = [(i, prose(rng, 80), "en", "s") for i in range(450)] + [(1000 + i, spam(), "en", "s") for i in range(30)] + [(2000 + i, lines(), "en", "s") for i in range(20)]
    rows += [(3000 + i, prose(rng, 80) if i % 2 else spam(), "en", "worst") for i in range(400)]
    out = quality.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in out)
    assert {r.doc_id for r in out if r.kept} == {i for i, *_ in rows if i < 450 or (i > 3000 and i % 2)}


def test_toxicity_scores_are_the_landmark_sum():
    """The collapsed weights give what the kernel with every landmark gives."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeß") for _ in range(rng.randint(3, 22)))
    suspects = pd.DataFrame({"unit": sorted({word() for _ in range(80)})}).assign(g=lambda d: np.arange(len(d), dtype=float), t=3)
    clean = pd.DataFrame({"unit": sorted({word() for _ in range(90)})}).assign(c=lambda d: 1 + np.arange(len(d)))
    machine = toxicity._Machine(suspects, clean)
    w = np.random.default_rng(0).normal(size=len(machine.marks) + 1)
    tried = [u for u in (word() for _ in range(300)) if len(u) <= toxicity.LONGEST]
    plain = toxicity.kernel(tried, machine.marks) @ machine.root @ w[:-1] + w[-1]
    assert np.allclose(machine.model(w).units(tried), np.maximum(plain, toxicity.FLOOR), atol=1e-4)


def test_toxicity_labels_that_contradict_each_other_teach_nothing(spark):
    rng = random.Random(3)
    docs = [(i, prose(rng, 40) + (" zorgblat" if i % 4 == 0 else ""), 1) for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    texts = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    doubled = labels + [(i, 1 - y) for i, y in labels if i % 10 == 1]
    without = [(i, y) for i, y in labels if i % 10 != 1]
    scores = lambda rows: {r.doc_id: round(r.score, 9) for r in toxicity.score(texts, toxicity.train(texts, frame(rows))).collect()}
    assert scores(doubled) == scores(without) == scores(doubled[::-1])


def test_chats_empty_and_very_long(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], schema))).count() == 0
    long_text = "<turn> \\l ok\n" * 60_000
    rows = [(1, 0, "user", long_text), (1, 1, "assistant", long_text + "end")] + [(2, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(400)]
    back = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, schema)))
    got = {r.conv_id: (r.n, r.t, len(r.loss), brute.sha(r.loss)) for r in back.select("conv_id", F.size("turns").alias("n"), chat.digest_turns(F.col("turns")).alias("t"), F.array_join("loss_texts", "").alias("loss")).collect()}
    assert got == brute.chats(rows)
