"""Best-fit packing of documents into token sequences, improved by swaps between underfull bins."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tripleweave.llm.common import stored, text_runs, typed
from tripleweave.llm.word_ids import encoder

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs together; bins it can't fill go on to the next round with those of other tasks.
LOT_PIECES = 8192
#: Bins below this fill may go on to the next round, at most one in eight of a lot.
CARRY_FILL = 0.98

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document's ids: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids and the end id; only longer ones than ``capacity`` are cut. Null text counts as empty.
    """
    schema, arrow = typed(_PIECES)

    def cut(batches):
        encode = encoder(tokenizer).texts
        for batch in batches:
            for rows, texts in text_runs(batch, "text"):
                ids, offsets = encode(texts)
                names = rows.column(0)
                of, piece, start, length, crc = [], [], [], [], []
                for k in range(len(texts)):
                    own = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), capacity):
                        part = own[at : at + capacity]
                        of.append(k), piece.append(at // capacity), start.append(at), length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                columns = [names.take(pa.array(of, pa.int64())), piece, start, length, crc]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers by best-fit decreasing: each item goes into the fullest bin that has room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit r: some bin has room for exactly r
    bins: list[list[int]] = []
    for item in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        size = lengths[item]
        fitting = present >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            to = room[free].pop()
            if not room[free]:
                present ^= 1 << free
            bins[to].append(item)
        else:
            free, to = capacity, len(bins)
            bins.append([item])
        if free > size:
            room[free - size].append(to)
            present |= 1 << (free - size)
    return bins


def _reachable(weights: np.ndarray, capacity: int) -> np.ndarray:
    """For every limit up to ``capacity`` the largest of the weights that is no larger, -1 if none is."""
    out = np.full(capacity + 1, -1, np.int64)
    inside = weights[weights <= capacity]
    out[inside] = inside
    return np.maximum.accumulate(out)


def _best_step(own: list[int], lengths: np.ndarray, x: int, fill: np.ndarray, item, bin_of, size, capacity: int) -> tuple | None:
    """The step that takes most out of bin ``x`` into a bin that stays within capacity and makes the sum of squared
    fills grow: ``(items that leave, item that comes or None, bin)``. All documents of the bin and all their pairs count,
    by the sums of lengths that they can make."""
    mine = lengths[own]
    several = mine[:, None] + mine[None, :]
    pairs = several[np.triu_indices(len(mine), 1)]
    one, two = _reachable(mine, capacity), _reachable(pairs, capacity)
    best, found = 0, None
    # move: into each bin the largest document that it has room for
    bins = np.flatnonzero((fill > 0) & (np.arange(len(fill)) != x))
    weight = one[capacity - fill[bins]]
    weight = np.where((weight > 0) & (fill[bins] > fill[x] - weight), weight, 0)
    if len(bins) and weight.max() > 0:
        most = np.flatnonzero(weight == weight.max())
        to = bins[most[fill[bins[most]].argmax()]]
        best, found = int(weight.max()), (_with_length(own, lengths, weight.max()), None, int(to))
    # exchange: for each document elsewhere the largest one or two of this bin that its bin has room for instead
    other = bin_of != x
    for table, pick in ((one, _with_length), (two, _pair_with_length)):
        room = size + capacity - fill[bin_of]
        gain = table[np.minimum(room, capacity)] - size
        gain = np.where(other & (gain > 0) & (fill[bin_of] > fill[x] - gain), gain, 0)
        if len(gain) and gain.max() > best:
            k = int(gain.argmax())
            best, found = int(gain[k]), (pick(own, lengths, gain[k] + size[k]), int(item[k]), int(bin_of[k]))
    return found


def _with_length(own: list[int], lengths: np.ndarray, length: int) -> tuple[int, ...]:
    return (next(i for i in own if lengths[i] == length),)


def _pair_with_length(own: list[int], lengths: np.ndarray, length: int) -> tuple[int, ...]:
    seen: dict[int, int] = {}
    for i in own:
        if (rest := int(length - lengths[i])) in seen:
            return seen[rest], i
        seen[int(lengths[i])] = i
    raise ValueError("no such pair")


def swap_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empties bins by moving documents, or exchanging one or two of a bin for one of another.

    The emptiest bins are taken first. Each step moves weight from a bin to a fuller one, so the sum of squared fills
    grows and the search ends: when there are as few bins as the total allows, or no bin can make a step.
    """
    fewest = -(-sum(lengths) // capacity)
    count = len(bins)
    sizes = np.array(lengths, np.int64)
    fill = np.array([sizes[b].sum() for b in bins], np.int64)
    holder = np.empty(len(sizes), np.int64)
    for k, b in enumerate(bins):
        holder[b] = k
    stuck = np.zeros(len(bins), bool)
    while count > fewest:
        open_bins = (fill > 0) & (fill < capacity)
        order = np.flatnonzero(open_bins & ~stuck)
        if open_bins.sum() < 2 or not len(order):
            break
        x = int(order[fill[order].argmin()])
        item = np.flatnonzero(open_bins[holder])
        step = _best_step(bins[x], sizes, x, fill, item, holder[item], sizes[item], capacity)
        if step is None:
            stuck[x] = True
            continue
        leaving, coming, to = step
        for i in leaving:
            bins[x].remove(i)
            bins[to].append(i)
            holder[i] = to
        if coming is not None:
            bins[to].remove(coming)
            bins[x].append(coming)
            holder[coming] = x
        for y in (x, to):
            fill[y] = sizes[bins[y]].sum()
        stuck[to] = False
        count -= fill[x] == 0
    return [b for b in bins if b]


def pack_lot(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of the items of one lot; full items stay alone."""
    part = [i for i, size in enumerate(lengths) if size < capacity]
    sizes = [lengths[i] for i in part]
    bins = swap_search(best_fit(sizes, capacity), sizes, capacity) if part else []
    return [[part[i] for i in b] for b in bins] + [[i] for i, size in enumerate(lengths) if size >= capacity]


def _packer(names: list[str], capacity: int, turn: int, last: bool):
    """Packs one lot: its rows with sequence id, offset, and whether their bin goes on to the next round."""

    def pack(key, table):
        lengths = table.column("length").to_pylist()
        bins = pack_lot(lengths, capacity)
        fills = [sum(lengths[i] for i in b) for b in bins]
        low = sorted((k for k in range(len(bins)) if fills[k] < CARRY_FILL * capacity), key=lambda k: fills[k])
        carried = set() if last else set(low[: max(1, len(bins) // 8)])
        base = (turn << 52) + (key[0].as_py() << 24)
        rows, ids, offsets, is_open = [], [], [], []
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                rows.append(i), ids.append(base + k), offsets.append(at), is_open.append(k in carried)
                at += lengths[i]
        out = table.select(names).take(pa.array(rows, pa.int64()))
        out = out.append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        return out.append_column("__open", pa.array(is_open, pa.bool_()))

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, lot_pieces: int = LOT_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Rounds: rows are dealt by hash into lots of about ``lot_pieces``; a task packs each lot by best fit and swaps.
    The emptiest bins of all lots, at most an eighth, are dealt anew in the next round, until one lot is left, so
    what is wasted at the end is that of one lot. Rounds grow as the logarithm of the rows. An empty table gives none.
    """
    rest = stored(pieces)
    names = rest.columns
    more = [StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("__open", BooleanType())]
    schema = StructType([*rest.schema.fields, *more])
    done, turn = None, 0
    while True:
        lots = max(1, -(-rest.count() // lot_pieces))
        last = lots == 1
        lot = F.pmod(F.xxhash64(*names, F.lit(turn)), F.lit(lots))
        dealt = rest.withColumn("__lot", lot).groupBy("__lot")
        packed = stored(dealt.applyInArrow(_packer(names, capacity, turn, last), schema))
        closed = packed.filter(~F.col("__open")).drop("__open")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        rest = packed.filter("__open").select(*names)
        turn += 1
