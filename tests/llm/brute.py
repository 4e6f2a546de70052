"""The operators' definitions, spelled out for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, size: int) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def reach(nodes, edges) -> dict:
    """The smallest node that each node reaches."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(rows: list[tuple[int | None, str | None]], size: int, percent: int) -> list[tuple]:
    """(id, set size, component, kept) of each row."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    named = [(i, s) for i, s in sets if i is not None and s]
    edges = [(a, b) for k, (a, x) in enumerate(named) for b, y in named[k + 1 :] if 100 * len(x & y) >= percent * len(x | y)]
    comp = reach({i for i, _ in sets if i is not None}, edges)
    return [(i, len(s), None if i is None else comp[i], i is None or comp[i] == i) for i, s in sets]


def backoff_scores(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(id, words, seen bigrams, log score): bigram stupid backoff by the counts of all other rows."""
    texts = [words(t) for _, t in rows]
    uni, bi = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    total = sum(uni.values())
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        u, b = Counter(t), Counter(zip(t, t[1:]))
        score, seen = 0.0, 0
        for k, v in enumerate(t):
            s = max(uni[v] - u[v], 0.5) / max(total - len(t), 1)
            if k:
                pair = (t[k - 1], v)
                if bi[pair] - b[pair] > 0:
                    s, seen = (bi[pair] - b[pair]) / max(uni[pair[0]] - u[pair[0]], 1), seen + 1
                else:
                    s *= 0.4
            score += math.log(s)
        out.append((i, len(t), seen, round(score, 4)))
    return out


def jump(key: int, shards: int) -> int:
    """The published loop."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def water_fill(sizes: list[float], weights: list[float], budget: float, ceiling: float) -> list[float]:
    """Targets by weight; what exceeds a ceiling is shared again until none does."""
    caps = [ceiling * s for s in sizes]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), budget * sum(sizes)
    while free:
        level = left / sum(weights[i] for i in free)
        full = {i for i in free if level * weights[i] > caps[i]}
        if not full:
            for i in free:
                out[i] = level * weights[i]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
        free -= full
    return out


def greedy_pieces(word: str, vocabulary: set[str]) -> int:
    """Longest match first; 1 where it cannot finish."""
    text, at, n = "▁" + word, 0, 0
    while at < len(text):
        end = next((e for e in range(len(text), at, -1) if text[at:e] in vocabulary), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n
