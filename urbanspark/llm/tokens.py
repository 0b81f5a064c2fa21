"""Token ids of texts by the tokenizers library, through a bounded cache of words.

Both supported kinds of tokenizer cut a text at single spaces and newlines before anything else, so the ids of a text are
the ids of its words, one after the other. Words seen before come from a cache in the Python worker; the library encodes
the others in batches: words of letters many to a text, cut apart again at the tokens that begin or end a word. A word's
closing mark is a token of its own and needs no entry. Texts in which that cut is not certain (runs of white space, other white space, text that may hold
a special token) are encoded whole.
"""

from __future__ import annotations

import os
from array import array
from functools import cache

import numpy as np

#: words kept by one Python worker
CACHE_WORDS = 700_000
_ODD_ASCII = ("  ", " \n", "\n ", "\n\n", "<|", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_ODD = tuple(chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
_PART_CHARS = 1 << 18
_MARKS = ".,;:!?"
_TOGETHER = 256


class WordEncoder:
    """spaced: a word's ids depend on the space before it (byte-level BPE); else white space is dropped."""

    def __init__(self, path: str):
        # a task has one core; the library's own threads would each keep memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.spaced = bool(ids("a b") != ids("a") + ids("b"))
        self.newline = array("I", ids("\n")).tobytes()
        self.lead = " " if self.spaced else ""
        self.marks = {m: array("I", ids(m)).tobytes() for m in _MARKS}
        #: tokens that begin a word (spaced) or end one
        self.largest = max(self.tokenizer.get_vocab().values())
        self.edge = np.zeros(self.largest + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.edge[i] = token.startswith("\u0120") if self.spaced else token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def _each(self, words: list[str], known: dict[str, bytes], before: str) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([before + w for w in part], add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()

    def _letters(self, words: list[str], known: dict[str, bytes]) -> set[str]:
        """Learn words of letters with a space before them; those that came out as one word each."""
        single: set[str] = set()
        parts = [words[at : at + _TOGETHER] for at in range(0, len(words), _TOGETHER)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([self.lead + " ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            cuts = [*edges.tolist(), len(ids)] if self.spaced else [0, *(edges + 1).tolist()]
            if len(cuts) != len(part) + 1 or cuts[0] or cuts[-1] != len(ids):
                self._each(part, known, self.lead)
                continue
            raw = ids.tobytes()
            known.update(zip(part, [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]))  # noqa: B905
            single.update(part)
        return single

    def _learn(self, new: set[str]) -> None:
        """Words with a space before them as they are, words that begin a line (spaced) with the newline."""
        known = self.known
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
        heads = [w for w in new if w[0] == "\n"]
        for w in heads:
            known[w] = self.newline + array("I", self.tokenizer.encode(w[1:], add_special_tokens=False).ids).tobytes()
        new.difference_update(heads)
        plain = {w for w in new if w.isalpha()}
        marked = {w: w[:-1] for w in new if w[-1:] in self.marks and w[:-1].isalpha()}
        single = self._letters(list(plain.union(marked.values())), known)
        odd = []
        for w in new:
            if (body := marked.get(w)) in single:
                known[w] = known[body] + self.marks[w[-1]]
            elif w not in plain:
                odd.append(w)
        self._each(odd, known, self.lead)

    def _plain(self, text: str) -> bool:
        return not (text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _ODD_ASCII) or (not text.isascii() and any(x in text for x in _ODD)))

    def _part(self, texts: list[str]) -> list[bytes]:
        get = self.known.get
        missing: set[str] = set()
        cut: list[tuple[list, list, list] | None] = []
        for text in texts:
            if not text or not self._plain(text):
                cut.append(None)
                continue
            units = ("\n" + text).replace("\n", " \n").split(" ")[1:] if self.spaced else text.replace("\n", " ").split(" ")
            ids = list(map(get, units))
            gaps = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            missing.update([units[i] for i in gaps])
            cut.append((units, ids, gaps))
        if missing:
            self._learn(missing)
        out = []
        for text, found in zip(texts, cut, strict=True):
            if found is None:
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b"")
                continue
            units, ids, gaps = found
            for i in gaps:
                ids[i] = self.known[units[i]]
            whole = b"".join(ids)
            out.append(whole[len(self.newline) :] if self.spaced else whole)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= _PART_CHARS:
                out += self._part(part)
                part, size = [], 0
        return out + (self._part(part) if part else [])


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker."""
    return WordEncoder(path)
