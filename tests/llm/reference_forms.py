"""Plain forms of the operators, for comparison on small tables."""

from __future__ import annotations

import itertools
import re

import numpy as np
import xxhash

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def fingerprint(text, n=3):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, threshold=2):
    label = dict(zip(range(len(ids)), ids))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(fps[i] ^ fps[j]).count("1") <= threshold and label[j] < label[i]:
                    label[i], changed = label[j], True
    return [label[i] for i in range(len(ids))]


def top_k(rows, k=10):
    usable = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]))
    out = []
    for at, (q, qv) in enumerate(usable):
        if q is None or q % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(qv, v)), i is None, i or 0, i)
                  for j, (i, v) in enumerate(usable) if j != at and len(v) == len(qv)]
        out += [(q, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def without_repeats(docs, window=13):
    """docs: (id, text) with distinct ids; id -> (words, removed, kept text)."""
    first = {}
    for i, text in docs:
        w = words(text)
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def near_copies(rows, words=5, similarity=0.8):
    """Keys that stay of (key, text) with distinct keys, all pairs compared."""
    def runs(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}

    sets = [runs(t) for _, t in rows]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for i, j in itertools.permutations(range(len(rows)), 2):
            if label[j] < label[i] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                label[i], changed = label[j], True
    return set(label)
