"""Plain-Python statements of the measures and of leaf matching, for comparison on small inputs."""

from __future__ import annotations

import re
import string
from collections import defaultdict

PUNCT = "".join(c for c in string.punctuation if c != ".")
NOISE = re.compile(rf"(?:[{re.escape(PUNCT)}]|\b[^\W\d_]{{1,2}}\b)\s*")


def clean(text: str) -> str:
    return NOISE.sub(" ", text).strip()


def lev(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit_sim(a: str, b: str) -> float:
    if not a and not b:
        return 0.0
    return max(0.0, 2.0 * (min(len(a), len(b)) - lev(a, b)) / (len(a) + len(b)))


def ratio(i: int, n1: int, n2: int) -> float:
    return float("inf") if n1 + n2 == i else i / (n1 + n2 - i)


def literal_sim(a: str, b: str, th: float) -> float:
    if a and b and a.lower() == b.lower():
        return 1.0
    ca, cb = clean(a), clean(b)
    if not ca or not cb:
        return 0.0
    ta, tb = ca.split(" "), cb.split(" ")
    if len(ta) > 1 and len(tb) > 1:
        return ratio(sum(edit_sim(x, y) >= th for x in ta for y in tb), len(ta), len(tb))
    return edit_sim(a, b)


def ending(uri: str) -> str:
    last = uri.strip("<>").rstrip("/").split("/")[-1]
    return last.split("#")[1] if "#" in last else last


def comparable(o: str) -> str:
    if o.startswith("<"):
        return "<" + ending(o)
    return o.split('"')[1] if o.startswith('"') else o


def block_table(t1, t2, pairs):
    return [
        (s1, comparable(o1), s2, comparable(o2), p1, p2)
        for q1, q2 in pairs
        for s1, p1, o1 in t1
        if p1 == q1
        for s2, p2, o2 in t2
        if p2 == q2
    ]


def leaves(blocks, th=0.7, skip_lowest=True, exclusive=False):
    """Level by level, as the operators define it."""
    shared, rows = defaultdict(set), defaultdict(list)
    for s1, l1, s2, l2, p1, p2 in blocks:
        shared[s1, s2].add((p1, p2))
        rows[s1, s2].append((l1, l2))
    levels = sorted({len(v) for v in shared.values()}, reverse=True)
    if len(levels) > 1 and skip_lowest:
        levels = levels[:-1]
    out = {}
    for level in levels:
        cut = {1: 0.95, 2: 0.9, 3: 0.8}.get(level, 0.7)
        taken = {s for pair in out for s in pair} if exclusive else set()
        for pair, common in shared.items():
            if len(common) != level or pair[0] == pair[1] or taken & set(pair):
                continue
            scores = [s for s in (literal_sim(a, b, th) for a, b in rows[pair]) if s > th]
            if scores and sum(scores) / level > cut:
                out[pair] = sum(scores) / level
    return out
