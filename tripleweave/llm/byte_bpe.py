"""Byte-level BPE: pre-tokens found by scanning transition functions over codepoint classes, merges per different
pre-token, and decoding from the offsets of the tokens' bytes."""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.common import offsets_of, take_lists, text_runs, typed

#: Different pre-tokens whose ids a worker remembers.
CACHE_SLICES = 400_000
#: Longer pre-tokens are merged one by one with a heap.
WIDE = 48
#: Characters per row of the scan.
SCAN_WIDTH = 128

# The white space of Unicode.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols the automaton reads: a character's class, with what follows it where the split depends on that.
LETTER, TAIL, PAIR, NUMBER, MARK, QUOTE, SPACE, BREAK, INNER = range(9)
# TAIL: s, t, m, d (a whole contraction); PAIR: the first of "re", "ve", "ll"; SPACE: a blank before anything but white
# space; BREAK: other white space there; INNER: white space before white space or the end of the text.

# States: what the text so far leaves open. FRESH: the next character begins a pre-token.
FRESH, WORD, DIGITS, MARKS, BLANK, GAP, APOSTROPHE, HALF, WHOLE = range(9)
# BLANK: a blank that joins what follows; GAP: in a run of white space; APOSTROPHE: one that began a pre-token;
# HALF, WHOLE: in and after a contraction.


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token begins, by symbol and state. Symbols from 9 on are those that begin a text."""
    after = np.zeros((18, 9), np.uint8)
    begins = np.ones((18, 9), bool)
    plain = {LETTER: WORD, TAIL: WORD, PAIR: WORD, NUMBER: DIGITS, MARK: MARKS, QUOTE: APOSTROPHE, SPACE: BLANK, BREAK: FRESH, INNER: GAP}
    for symbol, state in plain.items():
        after[symbol] = state
    joins = [
        (LETTER, WORD, WORD), (TAIL, WORD, WORD), (PAIR, WORD, WORD), (LETTER, BLANK, WORD), (TAIL, BLANK, WORD),
        (PAIR, BLANK, WORD), (NUMBER, DIGITS, DIGITS), (NUMBER, BLANK, DIGITS), (MARK, MARKS, MARKS), (MARK, BLANK, MARKS),
        (MARK, APOSTROPHE, MARKS), (QUOTE, MARKS, MARKS), (QUOTE, BLANK, MARKS), (QUOTE, APOSTROPHE, MARKS),
        (TAIL, APOSTROPHE, WHOLE), (PAIR, APOSTROPHE, HALF), (LETTER, HALF, WHOLE), (TAIL, HALF, WHOLE),
        (PAIR, HALF, WHOLE), (INNER, GAP, GAP),
    ]
    for symbol, state, then in joins:
        after[symbol, state], begins[symbol, state] = then, False
    for symbol in range(9):
        after[9 + symbol], begins[9 + symbol] = after[symbol, FRESH], True
    return after, begins


AFTER, BEGINS = _automaton()
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """LETTER, NUMBER, MARK or INNER (white space) of every codepoint."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter(
            (kinds.get(unicodedata.category(chr(c))[0], MARK) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1
        )
        table[_SPACES] = INNER
        table[ord("'")] = QUOTE
        _classes.append(table)
    return _classes[0]


def symbols(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """The automaton's symbols of codepoints; ``text_starts`` are the places where (non-empty) texts begin."""
    kinds = classes()[codes]
    first = np.zeros(len(codes) + 1, bool)
    first[text_starts] = True
    first[-1] = True
    same_text = ~first[1:]
    following = np.append(codes[1:], 0)
    out = kinds.copy()
    out[np.isin(codes, [ord(c) for c in "stmd"])] = TAIL
    for a, b in ("re", "ve", "ll"):
        out[(codes == ord(a)) & (following == ord(b)) & same_text] = PAIR
    ends = (kinds == INNER) & same_text & (np.append(kinds[1:], INNER) != INNER)
    out[ends] = np.where(codes[ends] == 32, SPACE, BREAK)
    out[first[:-1]] += 9
    return out


def scan_states(read: np.ndarray) -> np.ndarray:
    """The state before each symbol.

    Each symbol is a function from states to states; composing them is associative. The symbols are laid out in rows;
    all rows compose their functions at once, the rows' functions are composed by doubling, and a second pass over the
    rows starts each from its state.
    """
    n = len(read)
    rows = -(-n // SCAN_WIDTH)
    laid = np.zeros(rows * SCAN_WIDTH, np.uint8)
    laid[:n] = read
    columns = np.ascontiguousarray(laid.reshape(rows, SCAN_WIDTH).T).astype(np.int32) * 9
    table = AFTER.reshape(-1)
    whole = np.tile(np.arange(9, dtype=np.uint8), (rows, 1))
    for column in columns:
        whole = table[column[:, None] + whole]
    step = 1
    while step < rows:  # whole[r] becomes the composition of all rows up to r
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.append(np.uint8(FRESH), whole[:-1, FRESH])
    before = np.empty((SCAN_WIDTH, rows), np.uint8)
    for k, column in enumerate(columns):
        before[k] = state
        state = table[column + state]
    return before.T.reshape(-1)[:n]


def slices(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of ``texts`` as one binary array, and the offsets of each text's."""
    texts = texts.cast(pa.binary()) if not pa.types.is_binary(texts.type) else texts
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    data = b"".join(texts.to_pylist())
    codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    if not len(codes):
        return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
    widths = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
    places = offsets_of(widths)
    text_places = offsets_of(lengths)
    text_starts = np.unique(np.searchsorted(places, text_places[:-1][lengths > 0]))
    read = symbols(codes, text_starts)
    starts = np.flatnonzero(BEGINS.reshape(-1)[read.astype(np.int32) * 9 + scan_states(read)])
    bounds = np.append(places[starts], len(data))
    pieces = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]
    )
    return pieces, np.searchsorted(bounds[:-1], text_places)


class ByteBpe:
    """Encoder and decoder for a file of ranks."""

    def __init__(self, content: bytes):
        pairs = [line.split() for line in content.splitlines() if line]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_offsets = offsets_of(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right), merged.append(rank)
        order = np.argsort(keys)
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array(merged, np.int64)[order], 0)
        self.known: dict[bytes, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair put together, or a number above all ranks; negative ids are padding."""
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], 1 << 40)

    def _merge_equal(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids of pieces of ``size`` bytes, all merged at once: in each round every piece makes its first lowest merge."""
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, size)]
        ids = np.concatenate([ids, np.full((len(ids), 1), -1)], axis=1)
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(ids))
        places = np.arange(size)
        live, live_ids, live_ranks = rows, ids, ranks
        while len(live):
            at = live_ranks.argmin(axis=1)
            best = live_ranks[np.arange(len(live)), at]
            go = best < 1 << 40
            if not go.all():
                ids[live[~go]] = live_ids[~go]
                live, live_ids, live_ranks, at, best = live[go], live_ids[go], live_ranks[go], at[go], best[go]
                if not len(live):
                    break
            every = np.arange(len(live))
            behind = places[None, :] > at[:, None]
            live_ids[:, :-1] = np.where(behind, live_ids[:, 1:], live_ids[:, :-1])
            live_ids[:, -1] = -1
            live_ids[every, at] = best
            live_ranks[:, :-1] = np.where(behind[:, :-1], live_ranks[:, 1:], live_ranks[:, :-1])
            live_ranks[:, -1] = 1 << 40
            live_ranks[every, at] = self._rank(best, live_ids[every, at + 1])
            inner = every[at > 0]
            live_ranks[inner, at[inner] - 1] = self._rank(live_ids[inner, at[inner] - 1], best[inner])
        lengths = (ids >= 0).sum(axis=1)
        flat = ids[ids >= 0].astype("<u4").tobytes()
        ends = (offsets_of(lengths) * 4).tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def _merge_long(self, piece: bytes) -> bytes:
        """Ids of one long piece: merges wait in a heap by rank and place."""
        ranks = self.ranks
        starts = list(range(len(piece)))
        ends = [k + 1 for k in starts]
        before = [k - 1 for k in starts]
        alive = [True] * len(piece)

        def offer(a: int) -> None:
            b = ends[a]
            if b < len(piece):
                rank = ranks.get(piece[a : ends[b]])
                if rank is not None:
                    heapq.heappush(heap, (rank, a, ends[b]))

        heap: list[tuple[int, int, int]] = []
        for k in starts:
            offer(k)
        while heap:
            _, a, end = heapq.heappop(heap)
            b = ends[a]
            if not alive[a] or b >= len(piece) or ends[b] != end:
                continue
            alive[b] = False
            ends[a] = end
            if end < len(piece):
                before[end] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return np.array([ranks[piece[k : ends[k]]] for k in starts if alive[k]], "<u4").tobytes()

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        fresh: dict[bytes, bytes] = {}
        by_size: dict[int, list[bytes]] = {}
        for piece in pieces:
            if piece not in known:
                rank = self.ranks.get(piece)
                if rank is not None:
                    known[piece] = rank.to_bytes(4, "little")
                elif len(piece) > WIDE:
                    fresh[piece] = self._merge_long(piece)
                else:
                    by_size.setdefault(len(piece), []).append(piece)
        for size, group in by_size.items():
            for k in range(0, len(group), 20_000):
                fresh.update(zip(group[k : k + 20_000], self._merge_equal(group[k : k + 20_000], size)))
        out = [known[piece] if piece in known else fresh[piece] for piece in pieces]
        for piece, ids in fresh.items():
            if len(known) >= CACHE_SLICES:
                break
            if len(piece) <= WIDE:
                known[piece] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their offsets by text."""
        pieces, by_text = slices(texts)
        chosen = pieces.dictionary_encode()
        ids = self._ids(chosen.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, offsets = take_lists(
            np.frombuffer(b"".join(ids), np.uint32), offsets_of(lengths), chosen.indices.to_numpy().astype(np.int64)
        )
        return flat, offsets[by_text]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and their offsets by text."""
        data, places = take_lists(self.token_bytes, self.token_offsets, ids.astype(np.int64))
        return data.tobytes(), places[offsets]


_codecs: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """The worker's codec for a rank file."""
    if path not in _codecs:
        with open(path, "rb") as file:
            _codecs[path] = ByteBpe(file.read())
    return _codecs[path]


_DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Per document (``doc_id, text``; null text is empty): number of ids, and digests of the ids and of the bytes
    they decode to. One pass over the rows; ``ranks`` is a rank file that is present on every machine."""
    schema, arrow = typed(_DIGESTS)

    def digest(batches):
        bpe = codec(ranks)
        for batch in batches:
            for rows, texts in text_runs(batch, "text"):
                ids, offsets = bpe.encode(texts)
                data, places = bpe.decode(ids, offsets)
                raw, data = memoryview(ids.astype("<u4").tobytes()), memoryview(data)
                cuts, ends = (offsets * 4).tolist(), places.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), pa.array(np.diff(offsets)),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])], pa.string()),
                        pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string()),
                    ],
                    schema=arrow,
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(digest, schema)
