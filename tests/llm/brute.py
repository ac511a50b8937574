"""Plain restatements of what the operators return, for small tables."""

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def measures(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = list(zip(w, w[1:], w[2:]))
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            covered |= {i, i + 1, i + 2}
    n, again = len(w), len(covered)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again,
            n < 50 or 100 * again > 50 * n)


def fingerprint(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(marks):
    """id -> smallest id reachable over links of at most two bits; marks: id -> fingerprint."""
    up = {i: i for i in marks}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(marks)
    for a in ids:
        for b in ids:
            if b < a and (marks[a] ^ marks[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """source -> target, from source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while len(full) < len(order):
        level = (total - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in order if s not in full)
        over = {s for s in order if s not in full and w[s] * level > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else w[s] * level for s in order}
        full |= over
    return {s: cap * sizes[s] for s in order}


def sainte_lague(weights, total):
    won = dict.fromkeys(weights, 0)
    for _ in range(total):
        won[min(weights, key=lambda i: (-weights[i] / (2 * won[i] + 1), i))] += 1
    return won


def top_k(vectors, is_query, k):
    """query -> [(id, score)]; vectors: id -> list."""
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids])
    out = defaultdict(list)
    for at, q in enumerate(ids):
        if is_query(q):
            s = m @ m[at]
            out[int(q)] = [(int(ids[j]), int(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def jaccard_classes(texts):
    """id -> smallest id reachable over pairs of Jaccard 0.8 on five-word shingles, for id -> text."""
    def shingles(text):
        w = [x.lower() if x.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text)]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                x, y = sorted((len(sets[a]), len(sets[b])))
                if sets[a] == sets[b] or 10 * x >= 8 * y and 10 * (both := len(sets[a] & sets[b])) >= 8 * (x + y - both) > 0:
                    i, j = top(a), top(b)
                    up[max(i, j)] = min(i, j)
    return {i: top(i) for i in ids}
