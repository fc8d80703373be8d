"""Brute-force versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter


def repeats(texts: dict, depth: int = 200) -> dict:
    seen: Counter = Counter()
    raw = {k: (t or "").encode() for k, t in texts.items()}
    for t in raw.values():
        seen.update(t[i : i + depth] for i in range(len(t) - depth + 1))
    out = {}
    for k, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[k] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def ngram_groups(texts: dict, n: int = 4, percent: int = 85) -> dict:
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    parent, ids = {k: k for k in sets}, sorted(sets)
    by = {}
    for k in ids:
        for s in sets[k]:
            by.setdefault(s, []).append(k)
    seen = set()
    for held in by.values():
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                if (a, b) in seen:
                    continue
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(parent, a), find(parent, b)))
                    parent[y] = x
    return {k: (len(sets[k]), find(parent, k)) for k in ids}


def language_model(texts: dict, min_count: int, k: float, depth: int = 5) -> dict:
    """Scores by plain dictionaries: doc -> (held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    import math
    import zlib

    tokens = {d: [*words(t), ""] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    grams = [Counter() for _ in range(depth + 2)]  # by number of words
    for d, t in tokens.items():
        if not held[d]:
            for m in range(1, depth + 2):
                grams[m].update(tuple(t[i : i + m]) for i in range(len(t) - m + 1))
    total, kinds = sum(grams[1].values()), len(grams[1])
    for m in range(2, depth + 2):  # only runs whose context is frequent, and which occur twice without their first word
        grams[m] = {g: c for g, c in grams[m].items() if grams[m - 1].get(g[:-1], 0) >= min_count and grams[m - 1].get(g[1:], 0) >= 2}
    states = [{} for _ in range(depth + 1)]  # by length: context -> occurrences before words told apart

    def p(g):
        """Of the last word after the others, by states found so far."""
        if len(g) == 1:
            return (grams[1].get(g, 0) + 1) / (total + kinds + 1)
        shorter, n = p(g[1:]), states[len(g) - 1].get(g[:-1], 0)
        if not n:
            return shorter
        seen, c = grams[len(g) - 1][g[:-1]], grams[len(g)].get(g, 0)
        return ((c if c >= 2 else 0) + (seen - n + k) * shorter) / (seen + k)

    for m in range(1, depth + 1):
        sums = {}
        for g, c in grams[m + 1].items():
            if c >= 2:
                x = sums.setdefault(g[:-1], [0, 0.0, 0])
                x[0], x[1], x[2] = x[0] + c, x[1] + c * math.log(c / p(g[1:])), x[2] + 1
        for s, (n, fit, number) in sums.items():
            seen = grams[m][s]
            rest = seen - n
            if fit - n * math.log(seen) + (rest * math.log(rest / seen) if rest else 0) > math.log(total) / 2 * number:
                states[m][s] = n
    out = {}
    for d, t in tokens.items():
        runs = [tuple(t[max(0, i - depth) : i + 1]) for i in range(len(t))]
        out[d] = (held[d], len(t), sum(grams[1].get((w,), 0) > 0 for w in t), total, sum(math.log10(p(g[-1:])) for g in runs), sum(math.log10(p(g)) for g in runs))
    return out
