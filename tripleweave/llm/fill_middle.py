"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put together anew around sentinels.

A text's UTF-8 bytes are laid out in blocks of fixed size. Two Fenwick trees over the blocks hold how many units end in
each, and how many code points begin there. A cut after k units is found by binary lifting down the first tree, which
leads to the block of the k-th unit's end; only that block's bytes are looked at for the place itself. The same descent
leaves the code points before the block. A unit is a word with the white space before it; white space that ends a text
is one more unit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tripleweave.llm.common import text_runs

SEED = 42
#: Share of texts, in hundredths, that are rearranged, and of those the share with the suffix first.
RATE = 50
SUFFIX_FIRST = 80
BLOCK_BYTES = 1024

# The sentinels.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_SENTINELS = tuple(s.encode() for s in (PREFIX, SUFFIX, MIDDLE))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Fenwick:
    """Prefix sums of several counts per block; node i (from 1) covers the ``i & -i`` blocks that end with block i."""

    def __init__(self, counts: np.ndarray):
        sums = np.concatenate([np.zeros((1, counts.shape[1]), np.int64), counts.cumsum(axis=0)])
        at = np.arange(len(sums))
        self.nodes = (sums - sums[at - (at & -at)]).tolist()
        self.top = 1 << (len(sums) - 1).bit_length() >> 1

    def descend(self, wanted: int) -> tuple[int, list[int]]:
        """The block in which the running sum of the first count comes to ``wanted`` (1 or more, and no more than all),
        and the sums of all counts over the blocks before it."""
        place, before = 0, [0] * len(self.nodes[0])
        step = self.top
        while step:
            after = place + step
            if after < len(self.nodes) and before[0] + self.nodes[after][0] < wanted:
                place, before = after, [x + y for x, y in zip(before, self.nodes[after])]
            step >>= 1
        return place, before


class UnitIndex:
    """Units and code points of one text in UTF-8."""

    def __init__(self, data: bytes, block: int = BLOCK_BYTES):
        self.data, self.block = data, block
        raw = np.frombuffer(data, np.uint8)
        space = _IS_SPACE[raw]
        self.ends = ~space  # a unit's last byte: a word's last byte, or the last of all
        self.ends[:-1] &= space[1:]
        self.ends[-1:] = True
        self.begins = raw & 0xC0 != 0x80
        if len(raw):
            firsts = np.arange(0, len(raw), block)
            counts = [np.add.reduceat(mask, firsts, dtype=np.int64) for mask in (self.ends, self.begins)]
            self.tree = Fenwick(np.stack(counts, axis=1))
        self.units = int(self.ends.sum())

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if not units:
            return 0, 0
        number, (units_before, points_before) = self.tree.descend(units)
        low = number * self.block
        inside = np.flatnonzero(self.ends[low : low + self.block])
        end = low + int(inside[units - units_before - 1]) + 1
        return end, points_before + int(self.begins[low:end].sum())


def draws(doc_id: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers from the hexadecimal SHA-256 of the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transform(data: bytes, doc_id: int | None, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, block: int = BLOCK_BYTES):
    """``(units, form, prefix's code points, middle's code points, output)`` of one text."""
    index = UnitIndex(data, block)
    n = index.units
    if doc_id is None or not data or any(s in data for s in _SENTINELS):
        return n, "plain", None, None, data
    first, second, chosen, order = draws(doc_id, seed)
    if chosen % 100 >= rate:
        return n, "plain", None, None, data
    a, b = sorted((first % (n + 1), second % (n + 1)))
    (low, points_low), (high, points_high) = index.cut(a), index.cut(b)
    prefix, middle, suffix = data[:low], data[low:high], data[high:]
    p, s, m = _SENTINELS
    if order % 100 < suffix_first:
        return n, "spm", points_low, points_high - points_low, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", points_low, points_high - points_low, b"".join((p, prefix, s, suffix, m, middle))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from. A rearranged text holds no sentinel itself, so its three parts are what
    lies between them."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2)))
        .when(F.col(form) == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(F.col(output))
    )


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row of ``docs`` (``doc_id, text``).

    ``n`` counts units; ``form`` is plain, psm or spm; ``output`` is the whole rearranged text, or the text itself if
    plain, with null lengths. Null text is empty. Empty texts, texts that hold a sentinel and rows without a doc_id stay
    plain. Repeated rows come back as often as they are there, other columns are ignored, an empty table gives none.
    Cuts depend on doc_id and text alone, so a task that is run again gives the same rows.
    """
    out = StructType([
        StructField("doc_id", LongType()), StructField("n", LongType()), StructField("form", StringType()),
        StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType()),
    ])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            for rows, texts in text_runs(batch, "text"):
                ids = rows.column(0).to_pylist()
                found = [transform(t.as_py(), i, rate, suffix_first, seed) for i, t in zip(ids, texts.cast(pa.binary()))]
                columns = list(zip(*found)) if found else [()] * 5
                outputs = pa.array(columns[4], pa.binary()).cast(pa.string())
                arrays = [pa.array(c, k) for c, k in zip([ids, *columns[:4]], kinds)]
                yield pa.RecordBatch.from_arrays([*arrays, outputs], names=out.names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, out)


def digests(found: DataFrame) -> DataFrame:
    """The transformation's rows with SHA-256 of the output and of the text rebuilt from it, in place of the text."""
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"),
    )
