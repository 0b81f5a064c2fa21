"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(docs):
    """doc_id -> (n_shingles, component_id, kept) of rows (doc_id, text)."""
    sets = {i: shingles(t) for i, t in docs}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def repeated_bytes(docs, n=200):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256 of the rest)."""
    data = {i: (t or "").encode() for i, t in docs}
    seen = Counter(b[p : p + n] for b in data.values() for p in range(len(b) - n + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def chats(rows):
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256) of rows (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss))
    return out


def quality_base(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    covered = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def item_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def contaminated(docs, items, n=13):
    """list of (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of rows (doc_id, text), (item_id, text)."""
    windows = defaultdict(set)
    for i, t in items:
        w = item_terms(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, found = item_terms(t), set(), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if got := windows.get(tuple(w[p : p + size])):
                    hit.update(range(p, p + size))
                    found |= got
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def negatives(rows, n_pos=5, n_neg=5):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, vector, is_anchor)."""
    good = [(i, y, [math.floor(256 * float(x)) for x in v], a) for i, y, v, a in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: 2**63 if i is None else i
    out = []
    for ai, ay, av, _ in {(i, y, tuple(v), a) for i, y, v, a in good if a and i is not None}:
        scored = sorted(((sum(p * q for p, q in zip(av, v, strict=False)), i, y) for i, y, v, _ in good), key=lambda r: (-r[0], last(r[1])))
        for p, pi, _ in [r for r in scored if r[2] == ay and r[1] != ai][:n_pos]:
            fits = [r for r in scored if r[2] != ay and 80 * p <= 100 * r[0] <= 100 * p]
            out += [(ai, pi, k, ni, p, n) for k, (n, ni, _) in enumerate(fits[:n_neg], 1)]
    return sorted(out, key=str)


def edited(word, letters):
    """Words one edit away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}) - {word}


def spelling_counts(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def spelling_variants(counts):
    """word -> (form, root, n, n_near, form_n)."""
    letters, form, near = {c for w in counts for c in w}, {}, {}
    for w in counts:
        near[w] = edited(w, letters) & counts.keys()
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out
