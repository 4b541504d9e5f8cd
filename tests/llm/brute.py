"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def shingle_set(text: str | None, size: int) -> set:
    w = WORD.findall(ascii_lower(text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def components(n: int, links) -> list[int]:
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def near_duplicates(docs: list[tuple[int, str | None]], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component)."""
    docs = sorted(docs)
    sets = [shingle_set(t, size) for _, t in docs]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = Counter()
    for rows in where.values():
        for k, a in enumerate(rows):
            for b in rows[:k]:
                common[b, a] += 1
    links = [p for p, c in common.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)]
    comp = components(len(docs), links)
    return {d: (len(sets[i]), docs[comp[i]][0]) for i, (d, _) in enumerate(docs)}


def repeated_substrings(docs: list[tuple[int, str | None]], window: int) -> dict[int, tuple[int, int, int, str]]:
    """doc_id: (n_bytes, n_removed, n_spans, digest of the rest)."""
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + window] for _, b in data for i in range(len(b) - window + 1))
    out = {}
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out
