"""Plain versions of what the operators do, for small inputs."""

import hashlib
import re
from collections import Counter
from itertools import combinations

_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_groups(docs, k):
    """docs: (id, text) with different ids. {id: (set size, smallest id reached)}"""
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def cut_passages(docs, n):
    """docs: (id, text). [(id, bytes, removed, spans, hash)]"""
    texts = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, t in texts:
        for s in range(len(t) - n + 1):
            w = t[s : s + n]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - n + 1):
            if first[t[s : s + n]] < i:
                gone[s : s + n] = b"\1" * n
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def plain_words(text):
    return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").translate(_LOWER))


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def leaks(docs, items, k, threshold):
    """{row: {item: best similarity}} by trying every window."""
    out = {}
    for row, text in enumerate(docs):
        w = plain_words(text)
        for item, passage in items:
            p = plain_words(passage)
            if not p or item is None:
                continue
            own = min(k, len(p))
            want = bag(p, own)
            best = 0.0
            for s in range(max(1, len(w) - len(p) + 1)):
                part = w[s : s + len(p)]
                if len(part) < own:
                    continue
                have = bag(part, own)
                inter = sum((have & want).values())
                best = max(best, inter / (sum(have.values()) + sum(want.values()) - inter))
            if best >= threshold - 1e-12:
                out.setdefault(row, {})[item] = max(best, out.get(row, {}).get(item, 0))
    return out
