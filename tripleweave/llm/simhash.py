"""SimHash near duplicates: fingerprints that share a variant within half the radius are linked.

Two fingerprints differ in at most 2r bits exactly if some 64-bit word differs from each in at most r bits. Every
fingerprint therefore stands for all such words (2081 for r = 2), and fingerprints meet on them. Which words meet where
is decided by a linear check code over bits: a word's group is its syndrome, and the syndrome of fingerprint xor error
is syndrome(fingerprint) xor syndrome(error). So a fingerprint is sent once to every group that one of its variants
falls into, and the task of that group writes out just those variants, sorts them, and puts the fingerprints that share
one into a class. A group gives one row for every fingerprint of a class: no more rows than fingerprints, however many
pairs and shared variants there are.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tripleweave.llm.common import stored, text_runs, typed
from tripleweave.llm.components import components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Groups that variants are shuffled to: as many as it takes for about GROUP_VARIANTS in each, but no more than GROUP_BITS
#: bits name, unless a group would get more fingerprints than GROUP_MOST. This is about work per task only.
GROUP_VARIANTS = 1 << 24
GROUP_BITS = 8
GROUP_MOST = 16_000_000
#: Variants that a task writes out at a time.
VARIANTS_AT_ONCE = 1 << 20

SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits, each 1 if it is set in over half the hashes of the text's shingles; 0 without words.

    A-Z in lower case; words are runs of anything but ASCII white space; a text of fewer words is one shingle.
    """
    # bytes.lower and bytes.split know just ASCII letters and the six ASCII blanks
    data = b" ".join(text.encode("utf-8").lower().split())
    if not data:
        return 0
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(data)]
    view, digest = memoryview(data), xxhash.xxh64_digest
    if len(starts) <= words:
        hashes = [digest(data, seed)]
    else:
        hashes = [digest(view[a:b], seed) for a, b in zip(starts, ends[words - 1 :])]
    found = np.frombuffer(b"".join(hashes), ">u8")
    laid = np.zeros((-(-len(found) // 255), 255), np.uint64)  # a byte counts up to 255
    laid.reshape(-1)[: len(found)] = found
    counts = np.zeros((8, 8), np.int64)
    for bit in range(8):  # every eighth bit at once, one count per byte
        lanes = (laid >> np.uint64(bit) & np.uint64(0x0101010101010101)).sum(axis=1, dtype=np.uint64)
        counts[:, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    counts = counts.reshape(-1)
    return int(np.left_shift(np.uint64(1), SHIFTS[counts * 2 > len(found)]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of every row of ``doc_id, text``; null text is empty."""
    schema, arrow = typed("doc_id bigint, fp bigint")

    def scan(batches):
        for batch in batches:
            for rows, texts in text_runs(batch, "text"):
                found = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found.view(np.int64))], schema=arrow)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(scan, schema)


def errors(radius: int) -> np.ndarray:
    """All 64-bit words with at most ``radius`` bits set."""
    out = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return np.array(out, np.uint64)


def check_columns(bits: int) -> np.ndarray:
    """A fixed pseudo-random check code: one ``bits``-bit syndrome per bit of a word."""
    return np.random.default_rng(2081).integers(min(1, bits), 1 << bits, 64)


def syndromes(words: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exclusive or of the columns of each word's set bits, by one table per byte."""
    out = np.zeros(len(words), np.int64)
    for byte in range(8):
        table = np.zeros(256, np.int64)
        for b in range(8):
            table[np.arange(256) >> b & 1 == 1] ^= columns[8 * byte + b]
        out ^= table[(words >> np.uint64(8 * byte) & np.uint64(255)).astype(np.int64)]
    return out


def _mix(words: np.ndarray) -> np.ndarray:
    return words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)


def links_in_group(fps: np.ndarray, group: int, bits: int, radius: int) -> np.ndarray:
    """Rows ``(least, other)`` for the classes of fingerprints whose variants with syndrome ``group`` (of ``bits`` bits)
    collide: one for every fingerprint but the least of its class. Variants are written out in parts by further syndrome
    bits, so memory doesn't grow with the group; the classes are carried through all parts."""
    patterns = errors(radius // 2)
    finer = 0
    while len(fps) * len(patterns) >> (bits + finer) > VARIANTS_AT_ONCE:
        finer += 1
    columns = check_columns(bits)
    if finer:
        columns = columns | np.random.default_rng(64).integers(0, 1 << finer, 64) << bits
    total = bits + finer
    own = syndromes(fps, columns)
    order = np.argsort(own, kind="stable")
    fps, own = fps[order], own[order]
    starts = np.searchsorted(own, np.arange((1 << total) + 1))
    of_pattern = syndromes(patterns, columns)
    by_value = np.sort(fps)
    root = np.arange(len(fps))  # each fingerprint's class so far, as the place of a smaller one of it in by_value
    space = np.empty(VARIANTS_AT_ONCE * 3 // 2, np.uint64)
    for part in range(1 << finer):
        wanted = of_pattern ^ (group | part << bits)
        low, high = starts[wanted], starts[wanted + 1]
        sizes = high - low
        ends = np.cumsum(sizes)
        variants = space[: ends[-1]] if ends[-1] <= len(space) else np.empty(ends[-1], np.uint64)
        for a, b, e, end in zip(low.tolist(), high.tolist(), patterns, ends.tolist()):
            if b > a:
                np.bitwise_xor(fps[a:b], e, out=variants[end - b + a : end])
        ordered = np.sort(variants)
        shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(shared):
            continue
        # the shared variants' owners: a small table finds nearly all that aren't, then they are compared
        marks = np.zeros(1 << 16, bool)
        marks[_mix(shared)] = True
        maybe = np.flatnonzero(marks[_mix(variants)])
        at = np.minimum(np.searchsorted(shared, variants[maybe]), len(shared) - 1)
        maybe, at = maybe[shared[at] == variants[maybe]], at[shared[at] == variants[maybe]]
        span = np.searchsorted(ends, maybe, side="right")
        who = fps[high[span] - (ends[span] - maybe)]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        firsts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        least = np.repeat(np.minimum.reduceat(who, firsts), np.diff(np.append(firsts, len(at))))
        pairs = np.unique(np.stack([least, who], axis=1)[least != who], axis=0)
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]
        merge(root, np.searchsorted(by_value, pairs[:, 0]), np.searchsorted(by_value, pairs[:, 1]))
    other = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([by_value[root[other]], by_value[other]], axis=1)


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts the classes of ``a`` and ``b`` together, pair by pair; ``root`` has every node's least one and is changed."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def group_bits(count: int, size: int) -> int:
    """Bits that name the groups for ``count`` fingerprints of ``size`` variants each."""
    bits = 0
    while bits < GROUP_BITS and count * size >> bits > GROUP_VARIANTS:
        bits += 1
    while count * min(1.0, size / (1 << bits)) > GROUP_MOST:
        bits += 1
    return bits


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` within ``radius`` bits; ``distinct`` is a stored table."""
    bits = group_bits(distinct.count(), len(errors(radius // 2)))
    schema, arrow = typed("bucket int, fps binary")

    def spread_out(batches):
        columns = check_columns(bits)
        to = np.unique(syndromes(errors(radius // 2), columns))
        every = len(to) == 1 << bits
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            if every:  # some variant of every fingerprint falls into each group
                data = fps.tobytes()
                groups, blobs = list(range(1 << bits)), [data] * (1 << bits)
            else:
                group = (syndromes(fps, columns)[:, None] ^ to[None, :]).ravel()
                order = np.argsort(group, kind="stable")
                sent = np.repeat(fps, len(to))[order]
                groups, at = np.unique(group[order], return_index=True)
                ends = np.append(at[1:], len(sent))
                blobs = [sent[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist())]
                groups = groups.tolist()
            step = 256
            for k in range(0, len(groups), step):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(groups[k : k + step], pa.int32()), pa.array(blobs[k : k + step], pa.binary())], schema=arrow
                )

    def link(key, table):
        fps = np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint64)
        pairs = links_in_group(fps, key[0].as_py(), bits, radius)
        return pa.table({"a": pa.array(pairs[:, 0].view(np.int64)), "b": pa.array(pairs[:, 1].view(np.int64))})

    sent = distinct.select("fp").mapInArrow(spread_out, schema)
    return sent.groupBy("bucket").applyInArrow(link, "a bigint, b bigint").distinct()


def _grouped(rows: DataFrame, radius: int, also: DataFrame | None = None) -> DataFrame:
    """For every fp of the stored ``rows (doc_id, fp)`` its ``component`` (least fp) and ``component_id`` (least doc_id)."""
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = fingerprint_links(distinct, radius)
    member = components(links if also is None else links.unionByName(also))
    grouped = stored(
        distinct.join(member, distinct["fp"] == member["node"], "left").select(
            "fp", "least", F.coalesce("component", "fp").alias("component")
        )
    )
    ids = stored(grouped.groupBy("component").agg(F.min("least").alias("component_id")))
    return stored(grouped.join(ids, "component").select("fp", "component", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (``doc_id, text``, other columns are ignored).

    ``fingerprint`` is 16 hex digits; ``component_id`` is the least doc_id that can be reached over links of at most
    ``radius`` differing bits, null only if no row there has a doc_id. Null text is empty and has fingerprint zero,
    which is linked like any other. Repeated rows come back as often as they are there. An empty table gives none.
    """
    rows = stored(fingerprints(docs))
    named = _grouped(rows, radius)
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def survivors(docs: DataFrame, radius: int = RADIUS, rows: DataFrame | None = None, also: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of each component that with the least doc_id; all columns are kept.

    ``rows`` is a stored table ``(doc_id, fp)`` of ``docs`` if there is one already; ``also`` has further links ``(a, b)``
    between fingerprints of ``docs``.

    Of rows that share that id the one with the least text stays (null before all). Rows without a doc_id go where
    their component has one; of a component without any, one row stays.
    """
    named = _grouped(stored(fingerprints(docs)) if rows is None else rows, radius, also)
    keep = stored(named.select(F.col("component_id").alias("doc_id")).filter("doc_id is not null").distinct())
    kept = docs.join(keep, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy("text")
    kept = kept.withColumn("__turn", F.row_number().over(first)).filter("__turn = 1").drop("__turn")

    nameless = docs.filter("doc_id is null")
    at = docs.columns.index("text")

    def add_print(batches):
        for batch in batches:
            found = np.array([fingerprint(t or "") for t in batch.column(at).to_pylist()], np.uint64)
            columns = [*batch.columns, pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__fp"])

    printed = nameless.mapInArrow(add_print, StructType([*docs.schema.fields, StructField("__fp", LongType())]))
    alone = named.filter("component_id is null").select(F.col("fp").alias("__fp"), F.col("component").alias("__group"))
    first = Window.partitionBy("__group").orderBy("text")
    other = printed.join(alone, "__fp").withColumn("__turn", F.row_number().over(first)).filter("__turn = 1")
    return kept.select(*docs.columns).unionByName(other.select(*docs.columns))
