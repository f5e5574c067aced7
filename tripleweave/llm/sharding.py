"""Minimax contiguous sharding: the smallest capacity that lets ordered groups of equal texts fill the shards."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.common import dense_order, stored

OVERHEAD = 16
#: Group ends that the driver looks at per pass; each pass looks closer at the places where cuts may fall.
LOOKED_AT = 1 << 16


class _Ends:
    """Running sums after some of the ordered groups; between two known ones there may be others."""

    def __init__(self, total: int):
        self.known = [0, total]
        self.closed: set[int] = set()  # known ends with no unknown one right before them

    def add(self, found: list[tuple[int, int, int]]) -> None:
        """First and last end, and the number of ends, of stretches without a gap between them."""
        self.known = sorted({*self.known, *(e for first, last, _ in found for e in (first, last))})
        self.closed.update(first for first, _, _ in found)
        self.closed.update(last for _, last, n in found if n <= 2)

    def reach(self, target: int, hopeful: bool) -> int:
        """The farthest end up to ``target`` that is known; or, hopefully, that there may be."""
        k = bisect_right(self.known, target)
        at = self.known[k - 1]
        if not hopeful or at == target or k == len(self.known) or self.known[k] in self.closed:
            return at
        return target

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
        """Greedy cuts, the last at the end of all; None if the shards don't do."""
        out, at, total = [], 0, self.known[-1]
        for _ in range(shards):
            ahead = self.reach(at + capacity, hopeful)
            if ahead == at:
                return None
            at = ahead
            out.append(at)
            if at == total:
                return out
        return None

    def steps(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """As many greedy cuts as there are shards, wherever they get."""
        out, at = [], 0
        for _ in range(shards):
            at = max(at, self.reach(at + capacity, hopeful))
            out.append(at)
        return out

    def least(self, low: int, shards: int, hopeful: bool) -> int:
        high = self.known[-1]
        low = min(low, high)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.cuts(middle, shards, hopeful) else (middle + 1, high)
        return low


def search(total: int, most: int, shards: int, looked_at: int, look) -> tuple[int, list[int]]:
    """The smallest feasible capacity and where to cut. ``look(windows, step)`` gives, for every stretch of ``step``
    from the first window on, the first and the last group end that lie in a window, and how many do."""
    low = max(most, -(-total // shards))
    ends = _Ends(total)
    windows, step = [(0, total)], 2 * total
    while True:
        step = max(1, min(step // 2, -(-sum(b - a for a, b in windows) // looked_at)))
        ends.add(look(windows, step))
        sure = ends.least(low, shards, False)
        hoped = ends.least(low, shards, True)
        if sure == hoped:
            return sure, _even_cuts(ends, sure, shards)
        lows, highs = ends.steps(hoped, shards, False), ends.steps(sure, shards, True)
        windows = []
        for a, b in zip(lows, highs):
            left = ends.known[max(0, bisect_right(ends.known, min(a, b)) - 1)]
            right = ends.known[min(len(ends.known) - 1, bisect_left(ends.known, max(a, b) + 1))]
            if windows and left <= windows[-1][1]:
                windows[-1] = (windows[-1][0], max(right, windows[-1][1]))
            else:
                windows.append((left, right))


def capacity_and_cuts(ordered: DataFrame, shards: int, looked_at: int = LOOKED_AT) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and where to cut, in running sums of ``bytes`` over ``ordered``
    (``before``: the sum before each group; ``bytes``: its size, at least 1).

    The driver holds a bounded number of group ends. With them, the greedy check gives a capacity that surely does and
    one below which surely none does; where their greedy cuts differ, it asks for more ends in between, until both
    capacities are equal. Then cuts are put as near to equal shards as that capacity allows.
    """
    row = ordered.agg(F.sum("bytes").alias("total"), F.max("bytes").alias("most")).first()
    if row["total"] is None:
        return 0, []

    def look(windows: list[tuple[int, int]], step: int) -> list[tuple[int, int, int]]:
        end = F.col("before") + F.col("bytes")
        inside = F.lit(False)
        for a, b in windows:
            inside = inside | end.between(a + 1, b)
        slot = F.floor((end - 1 - windows[0][0]) / F.lit(step))
        rows = ordered.filter(inside).groupBy(slot.alias("slot")).agg(
            F.min(end).alias("first"), F.max(end).alias("last"), F.count(F.lit(1)).alias("n")
        )
        return [(int(r["first"]), int(r["last"]), int(r["n"])) for r in rows.collect()]

    return search(int(row["total"]), int(row["most"]), shards, looked_at, look)


def _even_cuts(ends: _Ends, capacity: int, shards: int) -> list[int]:
    known, total = ends.known, ends.known[-1]
    out, at = [], 0
    for turn in range(shards):
        left = shards - turn
        if at == total:
            break
        fair = at + -(-(total - at) // left)
        low, high = bisect_right(known, at), bisect_right(known, at + capacity) - 1
        k = min(max(bisect_left(known, fair), low), high)
        if k > low and fair - known[k - 1] < known[k] - fair:
            k -= 1

        def enough(j: int) -> bool:
            place, more = known[j], left - 1
            while place < total and more:
                place, more = ends.reach(place + capacity, False), more - 1
            return place == total

        if not enough(k):  # the farther the cut, the easier the rest; the farthest is the greedy one
            a, b = k, high
            while a < b:
                middle = (a + b) // 2
                a, b = (a, middle) if enough(middle) else (middle + 1, b)
            k = a
        at = known[k]
        out.append(at)
    return out


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Groups are rows of equal text (null as empty), ordered by their least doc_id, null last, then by digest; a group is
    never split. ``size`` is the text's UTF-8 bytes and 16. Shards are ranges of that order whose largest size is as
    small as can be; a group larger than an equal share sets that size. ``slot`` counts a shard's rows from 0 in the
    order of doc_id. Repeated rows each have a slot; an empty table gives none.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), (F.length(data) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("__digest"),
        )
    )
    groups = rows.groupBy("__digest").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    ordered = stored(dense_order(groups, [F.col("first").isNull(), "first", "__digest"], "bytes", "before"))
    _, cuts = capacity_and_cuts(ordered, shards)
    cut = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    placed = stored(ordered.select("__digest", F.size(F.filter(cut, lambda c: c <= F.col("before"))).alias("shard")))
    named = rows.join(placed, "__digest").drop("__digest").withColumn("__one", F.lit(1).cast("bigint"))
    ranked = stored(dense_order(named, ["shard", "doc_id", "text_crc32"], "__one", "__rank"))
    counts = {r["shard"]: r["n"] for r in ranked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = np.concatenate([[0], np.cumsum([counts.get(k, 0) for k in range(shards)])]).tolist()
    start = F.array(*[F.lit(int(s)).cast("bigint") for s in starts])
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__rank") - start[F.col("shard")]).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
