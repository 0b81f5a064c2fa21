"""Each operator on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark.llm import chat, decontaminate, language_id, line_dedup, minhash, packing, quality, suffix_dedup, token_files, toxicity
from urbanspark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, label string, kept string, score string, hash string, key string"


def table(spark, rows):
    """Documents with columns whose names clash with what operators use."""
    return spark.createDataFrame([(i, t, "en", "s", "a", "b", "c", "d", "e") for i, t in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "One TWO"), (6, "Ärger im Straßenverkehr"), (None, "no key at all here"), (7, "x" * 900), (8, "ab" * 700)]
    base = words(rng, 300)
    rows += [(10 + i, base) for i in range(5)]
    for i in range(20):
        w = base.split(" ")
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(300)] = words(rng, 1)
        rows.append((20 + i, " ".join(w)))
    rows += [(60 + i, words(rng, 40) + " " + base[200:700] + " " + words(rng, 40)) for i in range(8)]
    rows += [(80 + i, words(rng, 100)) for i in range(10)]
    rows.append((90, words(rng, 60_000)))
    return rows


def test_near_duplicates(spark, corpus):
    rows = [(i, t) for i, t in corpus if i is not None]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, corpus)).collect() if r.doc_id is not None}
    assert got == brute.near_groups(rows)


def test_near_duplicates_repeated_rows_and_keys(spark):
    rng = random.Random(6)
    a, b = words(rng, 50), words(rng, 50)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, [(5, a), (5, b), (7, a), (8, b), (7, a)])).collect())
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (7, 5, False), (8, 5, False)]
    rng = random.Random(9)
    first, second = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(first)), (5, " ".join(second)), (7, near(first)), (8, near(second)), (5, "lone text"), (9, "lone text"), (9, " ".join(first[:30]))]
    for turn in range(4):
        rng.shuffle(rows)
        got = minhash.near_duplicates(table(spark, rows).repartition(1 + turn)).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(5, 5)] * 3 + [(7, 5), (8, 5)] + [(9, 5)] * 2
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicate_open_pairs(spark):
    """Links that the first comparison with a bucket's smallest member misses."""
    rng = random.Random(7)
    base = words(rng, 200).split(" ")
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.sample(range(200), 5 if i % 3 else 9):
            w[p] = words(rng, 1)
        rows.append((100 + i, " ".join(w)))
        if i % 6 == 0:
            w[rng.randrange(200)] = "changed"
            rows.append((300 + i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == brute.near_groups(rows)


def test_near_duplicate_pairs_grow_with_the_rows(spark, monkeypatch):
    """Copies of a text whose smallest and largest ids are odd ones: the central copy links them, not pairs of them."""
    rng = random.Random(11)
    base = words(rng, 200).split(" ")
    rows = [(50, " ".join(base))]
    for i in [*range(40), *range(60, 100)]:
        w = list(base)
        for p in rng.sample(range(200), 4):
            w[p] = words(rng, 1)
        rows.append((i, " ".join(w)))
    made, stored = {}, minhash.stored

    def counted(df, name):
        made[name] = (out := stored(df, name)).count()
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == brute.near_groups(rows)
    assert made["pairs"] + made["met"] <= 2 * len(rows)


def test_repeated_bytes(spark, corpus):
    out = suffix_dedup.remove_repeats(table(spark, corpus)).select("doc_id", "n_bytes", "spans", F.sha2("kept_bytes", 256).alias("sha")).collect()
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.sha) for r in out}
    assert got == brute.repeated_bytes(corpus)
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_repeated_bytes_at_borders(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    rows = []
    for i in range(30):
        passage = letters(rng.choice([198, 199, 200, 201, 260, 400]))
        rows.append((2 * i, letters(rng.randint(0, 150)) + passage + letters(rng.randint(0, 150))))
        rows.append((2 * i + 1, letters(rng.randint(0, 150)) + passage + letters(rng.randint(0, 300)) + passage[-210:]))
    out = suffix_dedup.remove_repeats(table(spark, rows)).select("doc_id", "n_bytes", "spans", F.sha2("kept_bytes", 256).alias("sha")).collect()
    assert {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.sha) for r in out} == brute.repeated_bytes(rows)


def test_long_texts_in_stretches(spark, monkeypatch):
    """A text longer than a stretch gives the same samples, once each."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 9000, dtype=np.uint8)).decode()

    def samples():
        return sorted((int(p) - int(o[t[l]]) + s, int(h)) for _, _, o, s, t, _, place, lo, _, gram in suffix_dedup._sampled(pa.array([text])) for p, l, h in zip(place, lo, gram, strict=True))

    whole = samples()
    monkeypatch.setattr(suffix_dedup, "_STRETCH", 1000)
    assert samples() == whole


def test_chats(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (2, 0, "assistant", "<turn user>\n\\l\\b\\g>"), (2, 0, "assistant", "tie"), (2, None, None, None), (3, 5, "sys>\ntem", "x"), (None, 1, "assistant", "Ä"), (4, 0, "system", ""), (4, 1, "user", None), (4, 2, "assistant", "fin")]
    df = spark.createDataFrame([(*r, "z", "y") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string")
    made = chat.format_chats(df)
    back = chat.read_chats(made).select("conv_id", "valid", F.size("turns").alias("n"), chat.digest_turns(F.col("turns")).alias("t"), F.array_join("loss_texts", "").alias("loss")).collect()
    assert {r.conv_id: (r.n, r.t, len(r.loss), brute.sha(r.loss)) for r in back} == brute.chats(rows)
    assert {r.conv_id: r.valid for r in back} == {1: True, 2: False, 3: False, None: False, 4: True}
    assert made.where("array_join(transform(segments, s -> s.text), '') <> formatted").count() == 0


def test_line_dedup(spark):
    block = "\n".join(f"shared line {i} of the block" for i in range(12))
    own = lambda k: "\n".join(f"own {k} line {i}" for i in range(6))
    rows = [(1, block), (2, own(2) + "\n" + block + "\n" + own(22)), (3, own(3)), (4, None), (5, ""), (6, "\n\n\n\n"), (7, "single line"), (8, "single line"), (2, own(2) + "\n" + block + "\n" + own(22)), (None, own(9))]
    out = line_dedup.dedup_lines(table(spark, rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text == block and by[1][0].n_removed_lines == 0
    for i in (3, None, 7, 8, 6, 5, 4):
        assert by[i][0].text == dict(rows)[i] and by[i][0].n_removed_chunks == 0
    assert by[2][0].text == by[2][1].text and by[2][0].n_removed_lines == 12
    assert by[2][0].text.startswith("own 2 line 0") and by[2][0].text.endswith("own 22 line 5")
    assert len(out) == len(rows) and "score" in out[0]
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0


def test_line_dedup_by_brute_force(spark):
    """Chunks from the operator; which lines go, and what is left, in plain Python."""
    rng = random.Random(14)
    blocks = ["\n".join(words(rng, 6) for _ in range(rng.randint(2, 12))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(blocks) if rng.random() < 0.5 else rng.choice([words(rng, 5), "", " \t"]) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    rows += [rows[3], (70, "\n".join(words(rng, 4) for _ in range(30_000)))]
    rows += [(71, rows[-1][1]), (72, "\n".join(["again and", "again"] * 40))]
    df = table(spark, rows)
    cut = {r.text: [(c.start, c.n, c.body) for c in r.c] for r in df.select("text", line_dedup.chunks_of(F.col("text")).alias("c")).collect()}
    first, want, has_word = {}, [], lambda x: bool(brute.words(x))
    for i, t in sorted(rows):
        lines = t.split("\n")
        for start, n, body in cut[t]:
            assert body.split("\n") == lines[start : start + n] and sum(map(has_word, body.split("\n"))) >= line_dedup.MIN_LINES
            first.setdefault(body, (i, start, lines))
    for i, t in rows:
        lines, gone = t.split("\n"), set()
        for start, n, body in cut[t]:
            j, other, theirs = first[body]
            if (j, other) == (i, start):
                continue
            gone |= set(range(start, start + n))
            for step, at, their in ((-1, start - 1, other - 1), (1, start + n, other + n)):
                reach = line_dedup.REACH
                while 0 <= at < len(lines) and 0 <= their < len(theirs) and lines[at] == theirs[their] and reach >= has_word(lines[at]):
                    reach -= has_word(lines[at])
                    if not has_word(lines[at]) and not reach:
                        break
                    gone.add(at)
                    at, their = at + step, their + step
        want.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted(want) and any(len(a[1]) < len(b[1]) for a, b in zip(got, sorted(rows), strict=True))


def test_short_passages_go_up_to_their_ends(spark):
    """Passages of few lines in other surroundings; all lines beside them stay."""
    rng = random.Random(15)
    rows, passages = [], {}
    for m in (3, 4, 5, 6, 8, 10):
        for k in range(60):
            passage = [words(rng, 8) for _ in range(m)]
            for copy in range(2):
                own = [[words(rng, 8) for _ in range(rng.randint(1, 5))] for _ in range(2)]
                rows.append((1000 * m + 2 * k + copy, "\n".join(own[0] + passage + own[1])))
                passages[rows[-1][0]] = ("\n".join(own[0] + own[1]), m)
    found = {m: [] for m in (3, 4, 5, 6, 8, 10)}
    for r in line_dedup.dedup_lines(table(spark, rows)).collect():
        own, m = passages[r.doc_id]
        if r.doc_id % 2 == 0:
            assert r.n_removed_lines == 0
            continue
        assert all(x in r.text.split("\n") for x in own.split("\n"))
        found[m].append(r.text == own)
    shares = {m: sum(x) / len(x) for m, x in found.items()}
    assert all(shares[m] >= least for m, least in {3: 0.6, 4: 0.75, 5: 0.85, 6: 0.9, 8: 0.95, 10: 0.95}.items()), shares


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [(i, t) for i, t in corpus if i is not None] + [(200, "a  b \n c\t<|endoftext|>\n\n\nx   y  z "), (201, " lead"), (202, "don't\nI'll  ")]
    want, at = [], 0
    for i, t in sorted(rows):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    shards = token_files.write_shards(table(spark, rows), tokenizer_path("byte_bpe_50k.json"), 2)
    assert sorted(tuple(r) for r in token_files.read_shards(spark, shards).collect()) == want
    path, _, n = max(shards, key=lambda s: s[2])
    reader = token_files._open(token_files.scratch_dir(spark), f"{path}.arrow")
    ids, mask = token_files.sequence(reader, (n - 1) // token_files.SEQUENCE)
    assert np.unpackbits(mask).sum() == (n - 1) % token_files.SEQUENCE + 1 and not ids.flags.owndata and not mask.flags.owndata
    assert ids.dtype == np.uint16 and reader.schema.field("mask").type.value_type == "bool"
    assert token_files.token_files(table(spark, []), tokenizer_path("byte_bpe_50k.json"), 2).count() == 0


def test_language_id(spark):
    de, en = "der die das und nicht ist ein schöner Tag ", "the and that with this is a fine day "
    docs = spark.createDataFrame([(i, (de if i % 2 else en) * 3 + str(i), "de" if i % 2 else "en", "p") for i in range(40)] + [(90, None, "en", "p"), (91, "the", None, "p")], "doc_id long, text string, lang string, lang_pred string")
    model = language_id.train(docs)
    test = spark.createDataFrame([(1, "das ist nicht der Tag", "q"), (2, "this is the day", "q"), (3, None, "q"), (4, "", "q"), (5, "123 !?", "q"), (6, de * 80_000, "q")], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(test, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["de", "en", "und", "und", "und", "de"]
    assert all(0 <= s <= 1 for _, s in got.values())
    none = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(test, none).collect()} == {"und"}


def test_language_id_by_brute_force(spark):
    """Naive Bayes over the n-grams' buckets, counted and added up in plain Python."""
    import math
    from collections import Counter

    rng = random.Random(13)
    rows = [(i, words(rng, 30) + (" ñandú él" if i % 2 else " the of"), "es" if i % 2 else "en") for i in range(30)]
    rows += [rows[0], rows[0], (99, "", None), (97, "e " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = {(r.text or ""): (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert len(got) == 32
    place = {n: i for i, n in enumerate(model.langs)}

    def grams(text):
        s = text.lower() + "\0\0"
        for i in range(len(text)):
            h = 0x811C9DC5
            for c in s[i : i + 3]:
                h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
                yield ((((h ^ (h >> 15)) * 0x9E3779B1) & 0xFFFFFFFF) >> 16)

    for name in model.langs:
        counts = Counter(g for _, t, n in rows if n == name and t for g in grams(t))
        want = [math.log((counts[b] + 0.5) / (counts.total() + 0.5 * language_id.BUCKETS)) for b in range(0, language_id.BUCKETS, 97)]
        assert model.log_prob[place[name], ::97] == pytest.approx(want, abs=1e-4)
    for text, (pred, score) in got.items():
        if not any(c.isalpha() for c in text):
            assert (pred, score) == ("und", 0.0)
            continue
        n = Counter(grams(text))
        logs = [float(model.log_prior[k]) + sum(c * float(model.log_prob[k, b]) for b, c in n.items()) for k in range(len(model.langs))]
        best = max(range(len(logs)), key=logs.__getitem__)
        share = 1 / sum(math.exp(x - logs[best]) for x in logs)
        assert pred == model.langs[best] and 0 <= score <= 1 and score == pytest.approx(share, abs=0.02)
    assert language_id.identify(docs.where("false"), model).count() == 0


def test_language_scores_do_not_depend_on_the_batch():
    model = language_id.LanguageModel(("a", "b"), np.log([0.5, 0.5]), np.log(np.random.default_rng(1).dirichlet(np.ones(language_id.BUCKETS), 2)).astype(np.float32))
    texts = ["", "x", "ab", "hello there", "z" * 50]
    together = language_id.score_texts(model, texts)[1]
    assert together == pytest.approx([language_id.score_texts(model, [t])[1][0] for t in texts])


def test_quality_base(spark, corpus):
    rows = [*corpus, (300, "a b c d e f a b c d e f a b"), (301, "x\nx\n\n \nx\ny # $ *")]
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r.doc_id: tuple(r[c] for c in cols) for r in quality.measure(table(spark, rows)).select("doc_id", *cols).collect()}
    assert got == {i: brute.quality_base(t) for i, t in rows}


def test_quality_thresholds_adapt(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, 80), "en" if i % 2 else None, "s" if i % 3 else None) for i in range(900)]
    rows += [(1000, "# $ % | " * 40 + words(rng, 20), "en", "s"), (1001, None, "en", "s"), (1002, "w" * 60 + " " + " ".join("w" * 60 + str(i) for i in range(20)), None, None)]
    out = quality.filter_quality(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, kept string"))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert len(kept) == len(rows) and not kept[1000] and not kept[1001] and not kept[1002]
    assert sum(kept.values()) == 900
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.filter_quality(empty).count() == 0


def test_kernel_by_dynamic_programming():
    def product(s, t, order=3, decay=toxicity.DECAY):
        """Lodhi's recursion."""
        prime = np.ones((len(s) + 1, len(t) + 1))
        for _ in range(1, order):
            new = np.zeros_like(prime)
            for i in range(1, len(s) + 1):
                run = 0.0
                for j in range(1, len(t) + 1):
                    run = decay * run + (decay**2 * prime[i - 1, j - 1] if s[i - 1] == t[j - 1] else 0.0)
                    new[i, j] = decay * new[i - 1, j] + run
            prime = new
        return sum(decay**2 * prime[i, j] for i in range(len(s)) for j in range(len(t)) if s[i] == t[j])

    strings = ["abc", "abcabc", "stupid", "stxupid", "straße", "aaaa", "abca"]
    want = [[product(s, t) / np.sqrt(product(s, s) * product(t, t)) for t in strings] for s in strings]
    assert toxicity.kernel(strings, strings) == pytest.approx(np.array(want), abs=1e-6)


def test_two_toxicity_models_in_one_session(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, words(rng, 20) + (" zorgblat" if i % 3 == 0 else " quimpft" if i % 3 == 1 else "")) for i in range(120)], "doc_id long, text string")
    label = lambda k: docs.select("doc_id", (F.col("doc_id") % 3 == k).cast("int").alias("toxic"))
    one, two = toxicity.train(docs, label(0)), toxicity.train(docs, label(1))
    for k, model in ((0, one), (1, two), (0, one)):
        got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
        assert all((s >= 0.7) == (i % 3 == k) for i, s in got.items())
    long = spark.createDataFrame([(1, words(rng, 100_000) + " zorgblat"), (1, "zorgblat"), (1, "zorgblat")], "doc_id long, text string")
    assert len({r.score for r in toxicity.score(long, one).where("length(text) < 100").collect()}) == 1
    assert toxicity.score(docs.where("false"), one).count() == 0 and toxicity.train(docs.where("false"), label(0)).bias == toxicity.FLOOR


def test_kernel_tolerates_gaps():
    k = toxicity.kernel(["stupid", "stu-pid", "stxupid", "garden"], ["stupid"])[:, 0]
    assert k[0] == pytest.approx(1) and k[1] > 0.6 and k[2] > 0.6 and k[3] < 0.1


def test_toxicity(spark):
    rng = random.Random(10)
    bad = ["zorgblat", "quimpft", "vexnord"]

    def doc(toxic):
        w = words(rng, 60).split(" ")
        if toxic:
            w[rng.randrange(60)] = rng.choice(bad)
        return " ".join(w)

    rows = [(i, doc(i % 4 == 0), "x") for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(900, 1), (901, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(300, 400))
    assert got[900] == got[901] < 0.5
    hidden = spark.createDataFrame([(1, words(rng, 30) + " zor.gblat"), (2, words(rng, 30) + " z o r g b l a t")], "doc_id long, text string")
    assert all(r.score >= 0.7 for r in toxicity.score(hidden, model).collect())
    one_class = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(0 <= r.score < 0.5 for r in toxicity.score(docs, one_class).collect())


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [(i, t) for i, t in corpus if i is not None] + [(4, "one two")]
    want = []
    for i, t in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p // 2048, p, min(2048, len(ids) - p), zlib.crc32(ids[p : p + 2048].tobytes())) for p in range(0, len(ids), 2048)]
    out = packing.pack(table(spark, rows), tokenizer_path("word_bpe_49k.json"), 0).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(w[3] for w in want) // 2048)
    assert packing.pack(table(spark, []), tokenizer_path("word_bpe_49k.json"), 0).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 40), rng.randint(100, 1500), 2048]) for _ in range(rng.choice([3, 50, 3000]))]
    histogram = {}
    for s in sizes:
        histogram[s] = histogram.get(s, 0) + 1
    used, bins = {}, 0
    bins_of, _ = packing.plan(histogram)
    for n, filling in bins_of:
        assert n > 0 and sum(x * k for x, k in filling.items()) <= 2048
        bins += n
        for x, k in filling.items():
            used[x] = used.get(x, 0) + n * k
    assert used == histogram
    loads = []
    for s in sorted(sizes, reverse=True):  # best-fit decreasing
        fit = [i for i, x in enumerate(loads) if x + s <= 2048]
        if fit:
            i = max(fit, key=lambda i: loads[i])
            loads[i] += s
        else:
            loads.append(s)
    assert bins <= len(loads)


@pytest.mark.parametrize("times", [1, 50, 200, 1000, 1003])
def test_packing_search_beats_best_fit(times):
    """Largest first takes 4 sequences of 100 here, and 3 hold all, however often each piece stands there."""
    histogram = dict.fromkeys((41, 36, 33, 30, 29, 27, 26, 24, 20, 18, 16), times)
    found, proven = packing.plan(histogram, 100)
    assert proven and sum(n for n, _ in found) == 3 * times
    used = {x: sum(n * f.get(x, 0) for n, f in found) for x in histogram}
    assert used == histogram


def fewest_bins(sizes, capacity):
    """The least number of bins, by trying every place of every piece."""
    best = len(sizes)

    def fill(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for k in {load: k for k, load in enumerate(loads)}.values():
            if loads[k] + sizes[i] <= capacity:
                fill(i + 1, [*loads[:k], loads[k] + sizes[i], *loads[k + 1 :]])
        fill(i + 1, [*loads, sizes[i]])

    fill(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_packing_against_every_plan(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(8, 60) for _ in range(rng.randint(1, 10))), reverse=True)
    histogram = {s: sizes.count(s) for s in sizes}
    found, proven = packing.plan(histogram, 100)
    assert sum(n for n, _ in found) == fewest_bins(sizes, 100)
    assert proven or len(sizes) > 6


def test_dominated_fillings():
    counts = np.zeros(101, np.int64)
    counts[[10, 20, 31]] = 1
    assert packing.dominated({10: 1, 20: 1}, 31, counts, [10, 20, 31]) and not packing.dominated({31: 1}, 31, counts, [10, 20, 31])


def test_decontamination(spark, corpus):
    rng = random.Random(11)
    items = [(1, words(rng, 40)), (2, words(rng, 13)), (3, words(rng, 4)), (4, ""), (5, None), (6, words(rng, 40)), (6, words(rng, 15)), (7, "Straße, straße!")]
    rows = list(corpus)
    for i, t in items[:4]:
        rows.append((500 + i, words(rng, 30) + " " + (t or "").upper() + ", " + words(rng, 30)))
    rows += [(510, items[0][1] + "\n" + items[0][1]), (511, " ".join(items[0][1].split(" ")[3:17])), (511, "same key"), (512, "die straße straße straße hier")]
    bench = spark.createDataFrame([(*r, "a") for r in items], "item_id long, text string, term string")
    found, _ = decontaminate.decontaminate(table(spark, rows), bench)
    got = [(r.doc_id, r.n_words, r.n_hit, len(r.item_ids), brute.sha(",".join(sorted(map(str, r.item_ids)))), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found.collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(brute.contaminated(rows, items), key=key)
    for a, b in ((table(spark, []), bench), (table(spark, rows), bench.where("false"))):
        found, _ = decontaminate.decontaminate(a, b)
        assert found.where("n_hit > 0").count() == 0 and found.count() == a.count()


def test_proximity(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(13)))], "item_id long, text string")
    near = " ".join([f"w{i}" for i in range(6)] + ["between"] + [f"w{i}" for i in range(6, 13)])
    found, _ = decontaminate.decontaminate(table(spark, [(1, near), (2, "w0 w1 w2 alone")]), items, slop=2)
    got = {r.doc_id: (r.n_hit, {m.kind for m in r.matches or ()}) for r in found.collect()}
    assert got == {1: (0, {"proximity"}), 2: (0, set())}
