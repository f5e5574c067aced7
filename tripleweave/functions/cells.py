"""Counting similar words of all pairs of two lots of values, inside a task."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

_EPS = 1e-9
_COLUMNS = 2048  # words multiplied at a time

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not be able to import this package


def cell_hits(a: pa.Table, b: pa.Table, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the pairs of two lots with enough hits, and their hits.

    Words are taken from the frequent to the rare ones. Those that many values of both lots have are multiplied as dense
    columns, a few at a time; the others add their pairs one by one. Sums of whole numbers are exact in doubles.
    """
    if not a.num_rows or not b.num_rows:
        return np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64")
    sides = []
    for t in (a, b):
        w, c = t["w"].combine_chunks(), t["c"].combine_chunks()
        row = np.repeat(np.arange(t.num_rows), np.diff(w.offsets.to_numpy()))
        sides.append((row, w.flatten().to_numpy(), c.flatten().to_numpy().astype("float64")))
    words = np.intersect1d(sides[0][1], sides[1][1])
    hits = np.zeros((a.num_rows, b.num_rows))
    kept, load = [], []
    for row, w, c in sides:
        place = np.searchsorted(words, w)
        known = place < len(words)
        known[known] = words[place[known]] == w[known]
        row, place, c = row[known], place[known], c[known]
        order = np.argsort(place, kind="stable")
        kept.append((row[order], place[order], c[order]))
        load.append(np.bincount(place, minlength=len(words)))
    made = load[0] * load[1]
    frequent = made * 64 > hits.size
    columns = np.flatnonzero(frequent)
    for start in range(0, len(columns), _COLUMNS):
        chosen = columns[start : start + _COLUMNS]
        at = np.full(len(words), -1)
        at[chosen] = np.arange(len(chosen))
        dense = []
        for (row, place, c), n in zip(kept, hits.shape):
            inside = at[place] >= 0
            block = np.zeros((n, len(chosen)))
            block[row[inside], at[place[inside]]] = c[inside]
            dense.append(block)
        hits += dense[0] @ dense[1].T
    first = [np.concatenate(([0], np.cumsum(n))) for n in load]
    for x in np.flatnonzero(~frequent):
        (r1, _, c1), (r2, _, c2) = ((d[0][f[x] : f[x + 1]], None, d[2][f[x] : f[x + 1]]) for d, f in zip(kept, first))
        hits[np.ix_(r1, r2)] += np.outer(c1, c2)
    total = np.add.outer(a["n"].to_numpy(), b["n"].to_numpy()).astype("float64")
    i, j = np.nonzero((hits > 0) & (hits >= np.floor(total * share - _EPS) + 1) & (hits <= total))
    return i, j, hits[i, j].astype("int64")
