"""Matches between two lots of subjects, found inside a task."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

_MEETINGS = 1_000_000  # meetings looked at a time, about
_KEYS = 4_000_000  # keys of several values together that a lot may make

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not be able to import this package


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


class _Lot:
    """A lot's subjects in the order of their profiles, with their entries ``(row, place, block, weight)`` row by row."""

    def __init__(self, table: pa.Table):
        g = table["g"].combine_chunks().dictionary_encode()
        codes = g.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        self.table = table.take(pa.array(order))
        bounds = np.searchsorted(codes[order], np.arange(len(g.dictionary) + 1))
        self.rows_of = {name: (bounds[k], bounds[k + 1]) for k, name in enumerate(g.dictionary.to_pylist())}
        entries = self.table["e"].combine_chunks()
        sizes = np.diff(entries.offsets.to_numpy())
        flat = entries.flatten()
        self.row = np.repeat(np.arange(len(self.table)), sizes)
        self.id, self.block, self.weight = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))

    def keep(self, ids: np.ndarray) -> None:
        """Only entries whose ids the other lot has, too; ``place`` is their place among these."""
        place = np.searchsorted(ids, self.id)
        place[place == len(ids)] = 0
        kept = np.flatnonzero(ids[place] == self.id) if len(ids) else np.zeros(0, np.int64)
        order = kept[np.lexsort((place[kept], self.row[kept]))]
        self.row, self.place, self.block, self.weight = self.row[order], place[order], self.block[order], self.weight[order]
        self.first = np.searchsorted(self.row, np.arange(len(self.table) + 1))  # a row's first entry

    def entries(self, g: str, blocks: list[int]) -> np.ndarray:
        low, high = self.rows_of[g]
        own = np.arange(self.first[low], self.first[high])
        return own[np.isin(self.block[own], blocks)]


def _runs(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each of the counts, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _several(lot: _Lot, entries: np.ndarray, size: int) -> list[np.ndarray]:
    """Each choice of ``size`` entries of a row in different blocks, as arrays of entries, by row."""
    row, block = lot.row[entries], lot.block[entries]
    last = np.searchsorted(row, row, side="right")
    chosen = [np.arange(len(entries))]
    for _ in range(size - 1):
        tip = chosen[-1]
        n = last[tip] - tip - 1
        after = np.repeat(tip, n) + 1 + _runs(n)
        chosen = [np.repeat(c, n) for c in chosen]
        other = np.ones(len(after), bool)
        for c in chosen:
            other &= block[c] != block[after]
        chosen = [c[other] for c in chosen] + [after[other]]
    return [entries[c] for c in chosen]


def _ways(lot: _Lot, entries: np.ndarray, size: int) -> np.ndarray:
    """How many choices ``_several`` gives for each row of the lot."""
    out = np.zeros((3, len(lot.table)))
    if len(entries):
        key = np.stack([lot.row[entries], lot.block[entries]], axis=1)
        order = np.lexsort((key[:, 1], key[:, 0]))
        key = key[order]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        n = np.diff(np.r_[new, len(key)]).astype(float)
        for k in range(3):
            np.add.at(out[k], key[new, 0], n ** (k + 1))
    p1, p2, p3 = out
    return p1 if size == 1 else (p1 * p1 - p2) / 2 if size == 2 else (p1**3 - 3 * p1 * p2 + 2 * p3) / 6


def _codes(lots: tuple[_Lot, _Lot], chosen: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    """A number per choice of entries, the same for the same places on both sides."""
    out = [lot.place[c[0]].astype(np.int64) for lot, c in zip(lots, chosen)]
    range_ = width
    for k in range(1, len(chosen[0])):
        if range_ > (1 << 62) // max(1, width):  # numbers anew, so that they fit
            both, seen = np.unique(np.concatenate(out), return_inverse=True)
            out, range_ = [seen[: len(out[0])], seen[len(out[0]) :]], len(both)
        out = [x * width + lot.place[c[k]] for x, lot, c in zip(out, lots, chosen)]
        range_ *= width
    return out


def _met(row: np.ndarray, low: np.ndarray, n: np.ndarray, others: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different pairs of a row and the ``others[low : low + n]`` of its keys, a run of whole rows at a time."""
    held = np.flatnonzero(n)
    row, low, n = row[held], low[held], n[held]
    total = np.cumsum(n)
    start = 0
    while start < len(row):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + _MEETINGS, side="right")))
        end = int(np.searchsorted(row, row[end - 1], side="right"))  # to the row's end, so that no pair comes twice
        part = slice(start, end)
        j = others[np.repeat(low[part], n[part]) + _runs(n[part])]
        pairs = np.unique(np.repeat(row[part], n[part]).astype(np.int64) * width + j)
        yield pairs // width, pairs % width
        start = end


def lot_matches(a: pa.Table, b: pa.Table, plan: list[dict]) -> Iterator[tuple[_Lot, _Lot, np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(lot 1, lot 2, i, j, score, count)``: matched subjects of two lots by their rows, under the plans of their profiles.

    A pair that reaches its plan's threshold has ``size`` similar blocks of ``head``, so pairs meet at equal values of that
    many blocks together, or, for subjects to which that would be dearer, at single values of the head without its last
    ``size - 1`` blocks. Each pair that meets is scored by all its values once; nothing but matches leaves the task.
    """
    one, two = _Lot(a), _Lot(b)
    ids = np.intersect1d(one.id, two.id)
    one.keep(ids), two.keep(ids)
    width, n2 = len(ids), len(two.table)
    if not width:
        return
    known = one.row.astype(np.int64) * width + one.place
    by_value: dict = {}

    def single(rows: np.ndarray, g1: str, g2: str, blocks: list[int]):
        mine = one.entries(g1, blocks)
        mine = mine[rows[one.row[mine]]]
        low, n, others = values(g2, blocks)
        place = one.place[mine]
        return _met(one.row[mine], low[place], n[place], others, n2)

    def values(g2: str, blocks: list[int]):
        key = (g2, *sorted(blocks))
        if key not in by_value:
            theirs = two.entries(g2, blocks)
            theirs = theirs[np.argsort(two.place[theirs], kind="stable")]
            low = np.searchsorted(two.place[theirs], np.arange(width + 1))
            by_value[key] = low[:-1], np.diff(low), two.row[theirs]
        return by_value[key]

    def joint(rows: np.ndarray, g1: str, g2: str, head: list[int], size: int, theirs: list[np.ndarray]):
        mine = one.entries(g1, head)
        mine = mine[rows[one.row[mine]]]
        made = np.cumsum(_ways(one, mine, size))
        start = 0
        while start < len(made):  # some rows' keys at a time
            end = max(start + 1, int(np.searchsorted(made, (made[start - 1] if start else 0) + _KEYS, side="right")))
            part = mine[(one.row[mine] >= start) & (one.row[mine] < end)]
            start = end
            if not len(part):
                continue
            chosen = _several(one, part, size)
            left, right = _codes((one, two), [chosen, theirs], width)
            order = np.argsort(right, kind="stable")
            right = right[order]
            low = np.searchsorted(right, left)
            yield from _met(one.row[chosen[0]], low, np.searchsorted(right, left, side="right") - low, two.row[theirs[0]][order], n2)

    for p in plan:
        g1, g2, size, head = p["g1"], p["g2"], p["size"], p["head"]
        if g1 not in one.rows_of or g2 not in two.rows_of:
            continue
        rows = np.zeros(len(one.table), bool)
        rows[slice(*one.rows_of[g1])] = True
        if size == 1:
            ways = [single(rows, g1, g2, head)]
        else:
            early = head[: len(head) - size + 1]
            mine, theirs = one.entries(g1, early), two.entries(g2, head)
            meetings = np.bincount(one.row[mine], weights=values(g2, early)[1][one.place[mine]], minlength=len(rows))
            together = rows & (_ways(one, one.entries(g1, head), size) < meetings) & (_ways(two, theirs, size).sum() <= _KEYS)
            ways = [single(rows & ~together, g1, g2, early)]
            if together.any():
                ways.append(joint(together, g1, g2, head, size, _several(two, theirs, size)))
        for way in ways:
            for i, j in way:
                n = two.first[j + 1] - two.first[j]
                at = np.repeat(two.first[j], n) + _runs(n)
                of = np.repeat(np.arange(len(i)), n)
                wanted = i[of] * width + two.place[at]
                place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = known[place] == wanted
                score = np.bincount(of[hit], weights=one.weight[place[hit]] * two.weight[at[hit]], minlength=len(i)) / p["count"]
                found = np.flatnonzero(score > p["threshold"])
                if len(found):
                    yield one, two, i[found], j[found], score[found], p["count"]
