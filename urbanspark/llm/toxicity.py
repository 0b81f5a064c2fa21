"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over their common subsequences of ORDER characters, DECAY to the power of the lengths
they span in both, normalised by the strings' own kernels; gaps and inserted characters only lower a weight. A sentence's
value is that of its best place under the kernel: a word without its outer marks, the letters alone of a word with marks
inside, a spelled-out run of single characters put together, or a piece of a long word.

Training: the distinct sentences of a bounded sample of labelled documents take their document's label, clean where both
occur (so copies count once). Spark counts for each unit the toxic and clean sentences that hold it. Which place makes a
toxic document toxic is latent: in rounds, each toxic document gives its best units under the machine so far, of those
with more than ODDS times their share of toxic sentences, as positive instances; the negative ones are units of clean
sentences, the most frequent and those that the machine takes for toxic. A squared-hinge SVM is fitted on the Nyström
features of LANDMARKS units. As the kernel is a sum over subsequences, the landmarks' weights collapse into one weight a
subsequence, so a unit is scored by looking its own subsequences up. A document's score is a logistic curve, fitted on the
sample at its true class shares (a toxic document weighing MISS_COST times), of its two highest values and the density and sum of high ones.

Edge cases: a null, empty or blank text has no units and gets the curve's value for none (low). Labels that are null,
or that contradict each other under one key, teach nothing; with one class only, every score is that of no units. Texts are scored whole. Repeated rows are scored
alike. Ties between units are broken by the unit's text, so a table gives the same model again. An empty table gives an
empty result. Other columns stay; score is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, discard, small_batches, stored

ORDER = 3
DECAY = 0.6
LANDMARKS = 256
#: labelled documents of each class to learn from, about, chosen by a hash of the key
SAMPLE_DOCS = 4000
#: instances of each kind that reach the driver
INSTANCES = 8000
#: times its due share of toxic sentences from which a unit can make a document toxic
ODDS = 4.0
#: units that a toxic document gives at most
WITNESSES = 5
#: weight of the positive instances together, against the negative ones
BALANCE = 0.1
RIDGE = 0.3
#: a missed toxic document costs the score's curve as much as so many clean ones flagged
MISS_COST = 5.0
ROUNDS = 5
LONGEST = 16
#: words whose values a Python worker keeps
CACHE_WORDS = 500_000
FLOOR = -2.0
_EDGE = ".,;:!?\"'()[]{}«»¡¿…-*_#$%&|<>/\\=+~`^@"
_SPELLED = re.compile(r"(?<!\S)\w(?:[ .\-_*]\w){2,}(?!\S)")


def word_units(word: str) -> list[str]:
    """The units of one lower-case word: without outer marks, and the letters alone where marks stand inside."""
    bare = word.strip(_EDGE)
    found = [bare] if bare.isalpha() else [bare, "".join(c for c in bare if c.isalpha())]
    return [u for u in found if len(u) >= ORDER]


def _spelled(text: str, words: set[str]) -> list[str]:
    """Runs of single characters put together; text and its words are in lower case."""
    if sum(len(w) == 1 for w in words) < 3:
        return []
    return [w for w in ("".join(c for c in m[0] if c.isalnum()) for m in _SPELLED.finditer(text)) if len(w) >= ORDER]


def units_of(text: str) -> set[str]:
    """The distinct units of a text."""
    text = text.lower()
    words = set(text.split())
    return {u for w in words for u in word_units(w)}.union(_spelled(text, words))


def _pieces(unit: str) -> list[str]:
    """The unit, or overlapping pieces of LONGEST characters that cover it."""
    if len(unit) <= LONGEST:
        return [unit]
    half = LONGEST // 2
    return [unit[a : a + LONGEST] for a in range(0, len(unit) - half, half)]


_places: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    if length not in _places:
        at = np.array(list(combinations(range(length), ORDER)))
        _places[length] = at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)
    return _places[length]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of one length: rows, subsequence keys and values of their feature maps, each key once a row; values have unit norm a row."""
    length = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64).reshape(-1, length)
    at, weight = _subsequences(length)
    keys = np.zeros((len(words), len(at)), np.int64)
    for k in range(ORDER):
        keys = (keys << 21) | codes[:, at[:, k]]
    order = np.argsort(keys, axis=1, kind="stable")
    keys = np.take_along_axis(keys, order, 1)
    values = weight[order]
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    starts = np.flatnonzero(new.ravel())
    summed = np.add.reduceat(values.ravel(), starts)
    rows = starts // keys.shape[1]
    norm = np.sqrt(np.bincount(rows, summed**2, minlength=len(words)))
    return rows, keys.ravel()[starts], summed / norm[rows]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    lengths: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        lengths.setdefault(len(w), []).append(i)
    for at in lengths.values():
        for k in range(0, len(at), 500):
            part = at[k : k + 500]
            yield np.array(part), [words[i] for i in part]


def _maps(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of words of any lengths."""
    found = [(at[r], k, v) for at, part in _by_length(words) for r, k, v in [features(part)]]
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _look_up(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in known (ascending), and whether each is there."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of each pair; right is a bounded list (landmarks)."""
    rows, keys, values = _maps(right)
    known, slot = np.unique(keys, return_inverse=True)
    table = np.zeros((len(known), len(right)), np.float32)
    table[slot, rows] = values
    out = np.zeros((len(left), len(right)))
    for at, part in _by_length(left):
        r, k, v = features(part)
        place, hit = _look_up(known, k)
        r, v, place = r[hit], v[hit], place[hit]
        if len(r):
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            out[at[r[starts]]] = np.add.reduceat(table[place] * v[:, None].astype(np.float32), starts, axis=0)
    return out


@dataclass
class ToxicityModel:
    keys: np.ndarray  # subsequences of the landmarks, ascending
    weights: np.ndarray
    bias: float
    #: of document_values, and 1
    curve: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, 0.0, -4.0]))

    def units(self, words: list[str]) -> np.ndarray:
        """SVM value of each unit, that of its best piece."""
        owner, pieces = [], []
        for i, w in enumerate(words):
            for p in _pieces(w):
                owner.append(i)
                pieces.append(p)
        values = np.empty(len(pieces))
        for at, part in _by_length(pieces):
            r, k, v = features(part)
            place, hit = _look_up(self.keys, k)
            values[at] = np.bincount(r, np.where(hit, self.weights[place] * v, 0.0), minlength=len(part))
        out = np.full(len(words), FLOOR)
        np.maximum.at(out, owner, values + self.bias)
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """The highest unit of each word."""
        owner, units = [], []
        for i, w in enumerate(words):
            for u in word_units(w):
                owner.append(i)
                units.append(u)
        out = np.full(len(words), FLOOR)
        if units:
            np.maximum.at(out, owner, self.units(units))
        return out

    def digest(self) -> str:
        found = hashlib.blake2b(self.keys.tobytes() + self.weights.tobytes(), digest_size=16)
        found.update(repr(self.bias).encode())
        return found.hexdigest()

    def probability(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(values @ self.curve[:-1] + self.curve[-1], -40, 40)))


#: values of words under one model, known by its digest
_known: dict[str, float] = {}
_known_of = ""


def document_values(model: ToxicityModel, digest: str, texts: list[str | None]) -> np.ndarray:
    """Of each text the highest value, the second one, and the density and (as a logarithm) the sum of high ones."""
    global _known_of
    if _known_of != digest or len(_known) > CACHE_WORDS:
        _known.clear()
        _known_of = digest
    lowered = [(t or "").lower() for t in texts]
    sets = [set(t.split()) for t in lowered]
    new = [w for w in set().union(*sets) if w not in _known]
    _known.update(zip(new, model.words(new).tolist(), strict=True))
    out = np.empty((len(texts), 4))
    for i, (t, words) in enumerate(zip(lowered, sets, strict=True)):
        values = np.fromiter(map(_known.__getitem__, words), float, len(words))
        if spelled := _spelled(t, words):
            values = np.append(values, model.units(spelled))
        top = np.sort(np.partition(np.append(values, [FLOOR, FLOOR]), len(values))[len(values) :])
        high = np.maximum(values + 0.5, 0).sum()
        out[i] = top[1], top[0], high / np.sqrt(len(values) + 1), np.log1p(high)
    return out


def _valued(model: ToxicityModel, spark):
    """A UDF: text -> document_values."""
    small_batches(spark)
    shared, digest = spark.sparkContext.broadcast(model), model.digest()

    @F.pandas_udf("array<double>")
    def values(text: pd.Series) -> pd.Series:
        return pd.Series([x for a in range(0, len(text), 256) for x in document_values(shared.value, digest, text.iloc[a : a + 256].tolist())])

    return values


def _scorer(model: ToxicityModel, spark):
    small_batches(spark)
    shared, digest = spark.sparkContext.broadcast(model), model.digest()

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([x for a in range(0, len(text), 256) for x in shared.value.probability(document_values(shared.value, digest, text.iloc[a : a + 256].tolist()))])

    return score


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) of a linear squared-hinge SVM, by Newton steps on the active rows."""
    x = np.hstack([z, np.ones((len(z), 1))])
    reg = ridge * np.eye(x.shape[1])
    reg[-1, -1] = 1e-6
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(50):
        a = x[active] * cost[active, None]
        w = np.linalg.solve(reg + x[active].T @ a, a.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _spread(words: list[str], weight: np.ndarray, n: int) -> list[str]:
    """n of the words, heavy and far from those taken before under the kernel."""
    if len(words) <= n:
        return words
    rows, keys, values = _maps(words)
    known, slot = np.unique(keys, return_inverse=True)
    order = np.argsort(rows, kind="stable")
    first = np.searchsorted(rows[order], np.arange(len(words) + 1))
    chosen, nearest = [], np.zeros(len(words))
    while len(chosen) < n:
        i = int((weight * (1 - nearest)).argmax())
        chosen.append(i)
        own = order[first[i] : first[i + 1]]
        dense = np.zeros(len(known))
        dense[slot[own]] = values[own]
        nearest = np.maximum(nearest, np.bincount(rows, dense[slot] * values, minlength=len(words)))
    return [words[i] for i in chosen]


def _cut_up(units: pd.Series, weight: np.ndarray) -> tuple[list[str], np.ndarray]:
    """All pieces of the units, each with its unit's weight."""
    pieces = [(p, w) for u, w in zip(units, weight, strict=True) for p in _pieces(u)]
    return [p for p, _ in pieces], np.array([w for _, w in pieces])


class _Machine:
    """The Nyström features, and the latent SVM fitted on them."""

    def __init__(self, suspects: pd.DataFrame, clean: pd.DataFrame):
        bad, heavy = _cut_up(suspects["unit"], np.sqrt(np.maximum(suspects["g"].to_numpy(), 0.0)))
        good, common = _cut_up(clean["unit"], np.log1p(clean["c"].to_numpy(float)))
        marks = _spread(bad, heavy, LANDMARKS // 2) + _spread(good, common, LANDMARKS // 2)
        self.marks = list(dict.fromkeys(marks))
        value, vector = np.linalg.eigh(kernel(self.marks, self.marks))
        self.root = vector / np.sqrt(np.maximum(value, 1e-3))

    def features(self, words: list[str]) -> np.ndarray:
        return kernel(words, self.marks) @ self.root

    def model(self, w: np.ndarray) -> ToxicityModel:
        rows, keys, values = _maps(self.marks)
        known, slot = np.unique(keys, return_inverse=True)
        return ToxicityModel(known, np.bincount(slot, (self.root @ w[:-1])[rows] * values), float(w[-1]))

    def fit(self, suspects: pd.DataFrame, bags: list[list[str]], negative: pd.DataFrame, w: np.ndarray | None) -> np.ndarray:
        """Weights after ROUNDS of choosing each bag's witnesses; w: those of a machine before."""
        pieces = [(p, i) for i, u in enumerate(suspects["unit"]) for p in _pieces(u)]
        bad, owner = self.features([p for p, _ in pieces]), np.array([i for _, i in pieces])
        place = {u: i for i, u in enumerate(suspects["unit"])}
        inside = [np.array([place[u] for u in bag]) for bag in bags if bag]
        cut = [(p, n) for u, n in zip(negative["unit"], negative["c"], strict=True) for p in _pieces(u)]
        good, good_cost = self.features([p for p, _ in cut]), np.sqrt([float(n) for _, n in cut])

        def solve(votes: np.ndarray, best: np.ndarray) -> np.ndarray:
            x, sign = np.vstack([bad[best], good]), np.repeat([1.0, -1.0], [len(best), len(good)])
            cost = np.concatenate([votes * (BALANCE * good_cost.sum() / votes.sum()), good_cost])
            return _svm(x, sign, cost / cost.mean(), RIDGE)

        if w is None:
            w = solve(suspects["t"].to_numpy(float)[owner] ** 2, np.arange(len(pieces)))
        for _ in range(ROUNDS):
            value = bad @ w[:-1] + w[-1]
            order = np.lexsort((-value, owner))
            best = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]  # of each suspect, its best piece
            of_unit, votes = value[best], np.zeros(len(suspects))
            for ids in inside:
                top = ids[np.argsort(-of_unit[ids], kind="stable")[:WITNESSES]]
                votes[top[0]] += 1
                votes[top[1:]] += of_unit[top[1:]] > 0
            taken = np.flatnonzero(votes)
            w = solve(np.sqrt(votes[taken]), best[taken])
        return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    design = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -40, 40)))
        h = design.T @ (design * (weight * p * (1 - p))[:, None]) + 0.05 * np.eye(len(b))
        step = np.linalg.solve(h, design.T @ (weight * (y - p)) - 0.05 * b)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b


def _evidence(sentences: DataFrame) -> tuple[DataFrame, float]:
    """unit, t and c (toxic and clean sentences that hold it), g (surprise) and odds; the share of toxic sentences."""

    @F.pandas_udf("array<string>")
    def instances(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted(units_of(t)))

    seen = stored(sentences.select("y", F.explode(instances("sentence")).alias("unit")).groupBy("unit").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")), "units")
    toxic, n = sentences.agg(F.sum("y"), F.count(F.lit(1))).first()
    prior = (toxic or 0) / max(n, 1)
    both = F.col("t") + F.col("c")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (both * p))).otherwise(0.0)
    g = 2 * (part(F.col("t"), F.lit(prior)) + part(F.col("c"), F.lit(1 - prior)))
    odds = (F.col("t") + 0.1) / (F.col("c") + 0.1) * ((1 - prior) / prior) if 0 < prior < 1 else F.lit(0.0)
    return seen.select("unit", "t", "c", g.alias("g"), odds.alias("odds")), prior


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Learn from the labelled rows given; pass only rows that may teach."""
    spark = docs.sparkSession
    none = ToxicityModel(np.zeros(1, np.int64), np.zeros(1), FLOOR)
    y = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y in (0, 1)")
    y = y.groupBy("key").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    total = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return none
    share = {k: min(1.0, sample_docs / n) for k, n in total.items()}
    chosen = y.where(F.pmod(F.xxhash64("key", F.lit(8)), F.lit(1_000_000)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]) * 1_000_000)
    chosen = stored(chosen, "labelled-keys")
    near = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(bit_filter(chosen.select(F.xxhash64("key")))(F.xxhash64("key")))
    sample = stored(near.join(chosen, "key").where("text is not null").select("key", "text", "y"), "labelled")
    sentences = sample.select("y", F.explode(F.split("text", "[.!?\\n]+")).alias("sentence")).groupBy("sentence").agg(F.min("y").alias("y"))
    sentences = stored(sentences, "sentences")
    scored, prior = _evidence(sentences)
    clean = scored.where("c > 0")
    suspects = scored.where(F.col("odds") > ODDS).orderBy(F.desc("g"), "unit").limit(INSTANCES).toPandas()
    frequent = clean.orderBy(F.desc("c"), "unit").limit(INSTANCES).toPandas()
    if suspects.empty or frequent.empty or not 0 < prior < 1:
        return none

    wanted = spark.sparkContext.broadcast(frozenset(suspects["unit"]))

    @F.pandas_udf("array<string>")
    def suspected(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sorted(units_of(t) & wanted.value))

    bags = [list(r[0]) for r in sample.where("y = 1").orderBy("key", F.xxhash64("text")).select(suspected("text")).collect()]
    machine = _Machine(suspects, frequent)
    w = machine.fit(suspects, bags, frequent, None)
    hard = frequent
    for _ in range(2):
        # what the machine so far takes for toxic in clean sentences goes into the next one's training
        shared = spark.sparkContext.broadcast(machine.model(w))
        value = F.pandas_udf(lambda unit: pd.Series(shared.value.units(unit.tolist())), "double")  # noqa: B023
        found = clean.withColumn("v", value("unit")).orderBy(F.desc("v"), "unit").limit(INSTANCES).drop("v").toPandas()
        hard = pd.concat([hard, found]).drop_duplicates("unit")
        w = machine.fit(suspects, bags, hard, w)
    model = machine.model(w)
    seen = sample.orderBy("key", F.xxhash64("text")).select(_valued(model, spark)("text").alias("v"), "y").toPandas()
    weight = np.where(seen["y"] == 1, MISS_COST, 1.0) / seen["y"].map(share).to_numpy(float)
    model.curve = _logistic(np.array(seen["v"].tolist()), seen["y"].to_numpy(float), weight)
    discard(chosen, sample, sentences)
    return model


def score(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """df with score, the probability of label 1."""
    return df.withColumn("score", _scorer(model, df.sparkSession)(F.col(text)))
