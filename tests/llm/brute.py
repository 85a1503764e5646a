"""Plain versions of the contracts, one text after another."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def shingles(text):
    w = words((text or "").translate(LOW))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_groups(texts: dict):
    """doc_id -> smallest doc_id reachable by links of similarity 0.75 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where: dict = {}
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in where.get(s, ()))
        for j, n in shared.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def without_repeats(texts: list, length: int = 200):
    """(bytes, removed, spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + d[at:a], b
        out.append((len(d), sum(b - a for a, b in spans), len(spans), kept + d[at:]))
    return out


def contamination(texts: list, items: list):
    """(words, hit, items, sha256, contaminated) of each text."""
    windows: dict = {}
    for item, text in items:
        w = benchmark_words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = benchmark_words(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                names = windows.get(tuple(w[i : i + size]))
                if names:
                    hit.update(range(i, i + size))
                    found |= names
        found = sorted(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out
