"""Brute-force versions that the tests hold the operators against."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(seqs, length):
    """Which units each sequence loses: those in a window that starts anywhere else too."""
    count = Counter(s[i : i + length] for s in seqs for i in range(len(s) - length + 1))
    for s in seqs:
        gone, end = [False] * len(s), 0
        for i in range(len(s) - length + 1):
            if count[s[i : i + length]] > 1:
                gone[max(i, end) : i + length] = [True] * (i + length - max(i, end))
                end = i + length
        yield gone


def words_removed(texts, length=35):
    seqs = [tuple(WORDS.findall(t or "")) for t in texts]
    for s, gone in zip(seqs, repeated(seqs, length), strict=True):
        kept = " ".join(w for w, g in zip(s, gone, strict=True) if not g)
        yield len(s), sum(gone), hashlib.sha256(kept.encode()).hexdigest()


def bytes_removed(texts, length=400):
    seqs = [(t or "").encode() for t in texts]
    for s, gone in zip(seqs, repeated(seqs, length), strict=True):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(s), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(s, gone, strict=True) if not g)).hexdigest()


def shingled(text, size=5):
    w = WORDS.findall(text or "")
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def lcs(a, b):
    """Length of the longest common subsequence, bit-parallel."""
    where = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def near_classes(rows, similarity=0.8):
    """Per row (id, text) the least id of its class, and a number of the class."""
    texts = sorted({t or "" for _, t in rows})
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sh = [shingled(t) for t in texts]
    bags = [Counter(s) for s in sh]
    index = defaultdict(set)
    for i, s in enumerate(sh):
        for x in set(s):
            index[x].add(i)
    for i, s in enumerate(sh):
        for j in sorted({j for x in set(s) for j in index[x] if j < i}):
            shared = sum((bags[i] & bags[j]).values())
            if shared / (len(s) + len(sh[j]) - shared) >= similarity and root(i) != root(j):
                m = lcs(s, sh[j])
                if m / (len(s) + len(sh[j]) - m) >= similarity - 1e-12:
                    parent[root(i)] = root(j)
    least = {}
    at = {t: root(i) for i, t in enumerate(texts)}
    for d, t in rows:
        r = at[t or ""]
        least[r] = min(least.get(r, d), d)
    return [(least[at[t or ""]], at[t or ""]) for _, t in rows]
