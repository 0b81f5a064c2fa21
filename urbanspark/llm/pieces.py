"""SentencePiece ids of texts by vectorised merge rounds, and their texts again.

A model of byte-pair merges joins, again and again, the neighbours whose joint piece has the best score, the leftmost on a
tie. No piece holds a space mark behind another character, so a text is cut before its words and each distinct word is
merged once a batch. All words of a batch lie in one flat array of symbols. A round finds the least rank of a pair in each
word (a segmented minimum), merges all its pairs from the left, closes the gaps, and sets words aside that have no pair
left. Only pairs beside a merge are looked up again.

Merging all pairs of a rank at once gives the library's result unless the new piece makes a pair that goes before the rest
of that rank; for such ranks only pairs too far apart to meet in one piece are merged in the same round.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import small_batches

#: words kept by one Python worker with their ids
CACHE_WORDS = 600_000
_PART_CHARS = 1 << 20
_SPACE = "▁"
_NONE = np.int32(2**31 - 1)


class PieceEncoder:
    """The merge table of a model file. Models must be byte-pair merges with byte fallback and without text rewriting."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.processor = sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        probe = "  Ａﬁ éé\n"
        if sp.normalize(probe) != _SPACE + probe.replace(" ", _SPACE):
            raise ValueError("the model rewrites texts before it cuts them")
        if any(sp.is_unused(i) for i in range(n)) or not any(sp.is_byte(i) for i in range(n)):
            raise ValueError("the model has unused pieces or no byte fallback")
        self.byte_ids = np.zeros(256, np.int32)
        pieces: dict[str, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                pieces[sp.id_to_piece(i)] = i
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("a piece goes on beyond a space")
        #: characters without a piece of their own are symbols from `size` on
        self.size = n
        symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p}):
            symbols.setdefault(c, len(symbols) + n)
        self.of_char = np.full(0x110000, n + len(symbols), np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.width = n + len(symbols) + 1
        score = {p: sp.get_score(i) for p, i in pieces.items()}
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        halves = [(symbols[p[:k]] * self.width + symbols[p[k:]], i, ranks[score[p]]) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        halves.sort()
        self.joint = np.array([h[1] for h in halves] + [-1], np.int32)
        self.rank = np.array([h[2] for h in halves] + [_NONE], np.int32)
        self._hash(np.array([h[0] for h in halves], np.uint64))
        #: ranks whose piece is an end of a piece of the same or a better rank
        self.early = np.zeros(len(ranks), bool)
        for p in pieces:
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    if len(part) > 1 and part in score and score[p] >= score[part]:
                        self.early[ranks[score[part]]] = True
        self.gap = 2 * max(map(len, pieces)) + 2
        # spaces in a row merge last and among themselves, where all their pieces share the worst score
        rows = [k for k in range(2, 64) if _SPACE * k in pieces]
        self.row = max(rows, default=1)
        last = all(ranks[score[_SPACE * k]] == len(ranks) - 1 for k in rows) and not any(_SPACE * 2 in p and p.strip(_SPACE) for p in pieces)
        lone = "".join(c for c in "\n\t\r" if not any(c in p for p in pieces))
        self.words = re.compile(f"{_SPACE}*[^{_SPACE}{lone}]+|{_SPACE}+" + (f"|[{lone}]" if lone else ""))
        self.known: dict[str, bytes] = {}
        # then a long row is its full pieces and what a shorter row gives
        tried = self.merge([_SPACE * k for k in range(self.row, 8 * self.row)])
        repeats = all(b == tried[0] + a for a, b in zip(tried[self.row :], tried[2 * self.row :], strict=False))
        self.long_row = re.compile(f"{_SPACE}{{{8 * self.row},}}") if rows and last and repeats else None

    def _hash(self, keys: np.ndarray) -> None:
        """A table of places by a hash, and one by another hash for keys that clash in the first."""
        self.keys = np.r_[keys, np.uint64(2**64 - 1)]
        left, self.tables = np.arange(len(keys)), []
        factor = 0x9E3779B97F4A7C15
        while len(left):
            at = (keys[left] * np.uint64(factor)) >> np.uint64(44)
            table = np.full(1 << 20, len(keys), np.int32)
            table[at[::-1]] = left[::-1]
            self.tables.append((np.uint64(factor), table))
            left, factor = left[table[at] != left], (factor * 0xD1342543DE82EF95 | 1) % 2**64

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in the merge table of each pair of symbols; the last place stands for none."""
        keys = left.astype(np.uint64) * np.uint64(self.width) + right.astype(np.uint64)
        factor, table = self.tables[0]
        at = table[(keys * factor) >> np.uint64(44)]
        miss = self.keys[at] != keys
        for factor, table in self.tables[1:]:
            again = table[(keys[miss] * factor) >> np.uint64(44)]
            at[miss] = again
            miss[miss] = self.keys[again] != keys[miss]
        at[miss] = len(self.keys) - 1
        return at

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, which is not empty, as little-endian 32-bit integers."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        sym, at = self.of_char[code], np.arange(len(code), dtype=np.int32)
        pair = np.full(len(code), len(self.keys) - 1, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair[inside] = self._pairs(sym[inside], sym[inside + 1])
        rank = self.rank[pair]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            if (least == _NONE).any():
                left = least != _NONE
                done.append((word[~left], sym[~left], at[~left]))
                word, sym, at, pair, rank, least = (x[left] for x in (word, sym, at, pair, rank, least))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            # of pairs that overlap, every other one from the left
            order = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(np.r_[True, hit[1:] != hit[:-1] + 1], order, 0))
            hit = hit[(order - run) % 2 == 0]
            early = self.early[rank[hit]]
            if early.any():
                apart = np.r_[True, (word[hit[1:]] != word[hit[:-1]]) | (at[hit[1:]] - at[hit[:-1]] > self.gap)]
                hit = hit[apart | ~early]
            sym[hit] = self.joint[pair[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            word, sym, at, pair, rank = (x[keep] for x in (word, sym, at, pair, rank))
            new = hit - np.arange(len(hit))
            beside = np.zeros(len(sym), bool)
            beside[new] = beside[np.maximum(new - 1, 0)] = True
            new = np.flatnonzero(beside)
            pair[new], rank[new] = len(self.keys) - 1, _NONE
            new = new[: -1 if new[-1] + 1 == len(sym) else None]
            new = new[word[new] == word[new + 1]]
            found = self._pairs(sym[new], sym[new + 1])
            pair[new], rank[new] = found, self.rank[found]
        word, sym, at = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, sym, at = word[order], sym[order], at[order]
        ids, bounds = self._bytes(word, sym, code[at], len(words))
        raw, bounds = ids.tobytes(), (4 * bounds).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: B905

    def _bytes(self, word: np.ndarray, sym: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids in order, symbols without a piece as their bytes, and where each word begins and the last ends."""
        odd = sym >= self.size
        if odd.any():
            chars, which = np.unique(code[odd], return_inverse=True)
            raw = [self.byte_ids[np.frombuffer(chr(c).encode(), np.uint8)] for c in chars.tolist()]
            times = np.ones(len(sym), np.int64)
            times[odd] = np.array([len(r) for r in raw])[which]
            unknown = np.repeat(odd, times)
            word, sym = np.repeat(word, times), np.repeat(sym, times)
            sym[unknown] = np.concatenate([raw[i] for i in which.tolist()])
        return sym.astype("<i4"), np.searchsorted(word, np.arange(n + 1))

    def _cut(self, text: str) -> list[str]:
        """The words of a text; long rows of spaces give their full pieces first."""
        text = _SPACE + text.replace(" ", _SPACE)
        if self.long_row is None or _SPACE * (8 * self.row) not in text:
            return self.words.findall(text)
        out: list[str] = []
        for w in self.words.findall(text):
            found = self.long_row.match(w)
            full = (found.end() // self.row - 4) * self.row if found else 0
            out += [_SPACE * self.row] * (full // self.row) + [w[full:]]
        return out

    def _part(self, texts: list[str]) -> list[bytes]:
        cut = [self._cut(t) if t else [] for t in texts]
        known = self.known
        seen = set().union(*cut)
        new = list(seen.difference(known))
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(seen)
        if new:
            known.update(zip(new, self.merge(new), strict=True))
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; a null text has none."""
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= _PART_CHARS:
                yield from (np.frombuffer(b, "<i4") for b in self._part(part))
                part, size = [], 0
        yield from (np.frombuffer(b, "<i4") for b in self._part(part))

    def decode(self, ids: np.ndarray) -> str:
        return self.processor.decode(ids.tolist())


@cache
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder a Python worker."""
    return PieceEncoder(path)


def encode_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with `ids` (the library's ids of the whole text, no begin or end) and `decoded` (their text again).

    A null or empty text has no ids and decodes to the empty text. Every row is encoded by itself, so repeated rows, ties
    and null keys keep their rows; all columns stay, but those named `ids` or `decoded` give way. No shuffle. A worker holds
    one batch of texts, one encoder and CACHE_WORDS words; a text of any length is one row, merged whole.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in batches:
            ids = list(encoder.encode(batch.column(text).to_pylist()))
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array([encoder.decode(i) for i in ids], pa.string())], names=[*batch.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)
