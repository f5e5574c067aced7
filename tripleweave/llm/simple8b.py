"""Token ids in files of Simple-8b words: several ids per 64-bit word, read back with array operations.

File: blocks, one after another, each followed by a line feed. Block, little-endian: eight 64-bit numbers (magic,
documents, ids, sub-blocks, words, escapes, two spare), then per document its id, a byte telling whether it has one,
and its number of ids; the word offset of each sub-block of 1024 ids; the words; the escaped ids.
A word's upper four bits select how many ids of how many bits its other 60 hold. Selector 15 stands for one id that
needs more than 60 bits: the word holds its place among the escapes.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleweave.llm.common import offsets_of, stored, text_runs, typed
from tripleweave.llm.word_ids import encoder
from tripleweave.operators.checkpoints import checkpoint_folder

#: Fixed values of the code: ids per word and bits per id, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 60])
ESCAPE = 15
SUB_BLOCK = 1024
MAGIC = 0x3142385342304B54
#: Blocks hold about this many bytes of text, files at most so many blocks.
FILE_BLOCKS = 8


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offsets of the sub-blocks, and escapes of unsigned 64-bit ``ids``."""
    large = ids > np.uint64((1 << 60) - 1)
    escapes = ids[large].astype(np.uint64)
    values = ids.astype(np.uint64)
    values[large] = np.arange(len(escapes), dtype=np.uint64)
    words, offsets, before = [np.zeros(0, np.uint64)], [np.zeros(1, np.uint64)], 0
    for low in range(0, len(ids), 512 * SUB_BLOCK):  # slices that stay in the processor's cache
        part = slice(low, low + 512 * SUB_BLOCK)
        packed, ends = _pack_slice(values[part], large[part])
        words.append(packed), offsets.append((ends + before).astype(np.uint64))
        before += len(packed)
    return np.concatenate(words), np.concatenate(offsets), escapes


def _pack_slice(values: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and where each sub-block's words end.

    Every place is given the densest selector that fits there; then all sub-blocks step through their places at once.
    """
    n = len(values)
    starts = np.arange(0, n, SUB_BLOCK)
    ends = np.minimum(starts + SUB_BLOCK, n)
    bits = np.zeros((len(starts), SUB_BLOCK + COUNTS[0]), np.uint8)  # what is behind a sub-block fits anything
    needs = np.zeros(len(starts) * SUB_BLOCK, np.uint8)
    exponent = (values.astype(np.float64).view(np.int64) >> 52) - 1022  # bits an id needs; may be one more from 2**53 on
    needs[:n] = np.where(large, 64, np.clip(exponent, 0, 60))
    bits[:, :SUB_BLOCK] = needs.reshape(-1, SUB_BLOCK)
    choice = np.full((len(starts), SUB_BLOCK), 13, np.int8)
    misfits = np.zeros((len(starts), bits.shape[1] + 1), np.int16)
    for selector in range(12, -1, -1):
        np.cumsum(bits > BITS[selector], axis=1, dtype=np.int16, out=misfits[:, 1:])
        ids_held = COUNTS[selector]
        fits = misfits[:, ids_held : ids_held + SUB_BLOCK] == misfits[:, :SUB_BLOCK]
        if not fits.any():
            break  # a denser selector asks for more ids of fewer bits
        np.copyto(choice, selector, where=fits)
    choice = choice.reshape(-1)
    choice[:n][large] = ESCAPE
    begins = np.zeros(n, bool)
    place, alive = starts.copy(), np.arange(len(starts))
    while len(alive):
        here = place[alive]
        begins[here] = True
        place[alive] = here + COUNTS[choice[here]]
        alive = alive[place[alive] < ends[alive]]
    firsts = np.flatnonzero(begins)
    selectors = choice[firsts].astype(np.int64)
    words = selectors.astype(np.uint64) << np.uint64(60)
    ahead = np.zeros((len(starts), SUB_BLOCK + COUNTS[0]), np.uint64)
    ahead[:, :SUB_BLOCK] = np.append(values, np.zeros(len(needs) - n, np.uint64)).reshape(-1, SUB_BLOCK)
    ahead, padded = ahead.reshape(-1), firsts + firsts // SUB_BLOCK * COUNTS[0]
    for selector in np.unique(selectors).tolist():
        rows = np.flatnonzero(selectors == selector)
        held = np.zeros(len(rows), np.uint64)
        for k in range(COUNTS[selector]):
            held |= ahead[padded[rows] + k] << np.uint64(k * BITS[selector])
        words[rows] |= held
    return words, np.append(np.searchsorted(firsts, starts[1:]), len(firsts))


def unpack_words(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of ``pack_words``."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    offsets = offsets.astype(np.int64)
    sizes = np.full(len(offsets) - 1, SUB_BLOCK)
    sizes[-1] = n - SUB_BLOCK * (len(sizes) - 1)
    counts[offsets[1:] - 1] -= np.add.reduceat(counts, offsets[:-1]) - sizes  # a sub-block's last word may have gaps
    firsts = offsets_of(counts)[:-1]
    for selector in np.unique(selectors).tolist():
        rows = np.flatnonzero(selectors == selector)
        bits = int(BITS[selector])
        for k in range(COUNTS[selector]):
            has = rows[counts[rows] > k]
            value = words[has] >> np.uint64(k * bits) & np.uint64((1 << bits) - 1)
            out[firsts[has] + k] = escapes[value.astype(np.int64)] if selector == ESCAPE else value
    return out


def block_bytes(doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack_words(ids)
    head = np.array([MAGIC, len(lengths), len(ids), len(offsets) - 1, len(words), len(escapes), 0, 0], "<u8")
    known = np.asarray(doc_ids.is_valid()).astype(np.uint8)
    names = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    parts = (head, names, known, lengths.astype("<u8"), offsets.astype("<u8"), words.astype("<u8"), escapes.astype("<u8"))
    return b"".join(part.tobytes() for part in parts)


def read_blocks(content: bytes):
    """Yields ``doc_ids (Arrow), lengths, ids`` of each block of a file."""
    at = 0

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(content, kind, count, at)
        at += got.nbytes
        return got

    while at < len(content):
        magic, docs, n, subs, words, escapes, _, _ = take(8, "<u8").tolist()
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at - 64}")
        names, known, lengths = take(docs, "<i8"), take(docs, "u1"), take(docs, "<u8")
        offsets, packed, escaped = take(subs + 1, "<u8"), take(words, "<u8"), take(escapes, "<u8")
        at += 1
        yield pa.array(names, mask=known == 0), lengths.astype(np.int64), unpack_words(packed, offsets, escaped, n)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, file_blocks: int = FILE_BLOCKS) -> None:
    """Encodes ``docs`` (``doc_id, text``) and writes the ids in ascending order of doc_id, null first.

    Texts are dealt by ranges of (doc_id, hash of the text), so that neither null nor repeated ids make a hot range.
    File names ascend with doc_id. Spark's writer commits the files, whatever store ``path`` is in.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("__tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "__tie").sortWithinPartitions("doc_id", "__tie")

    def blocks(batches):
        encode = encoder(tokenizer).texts
        for batch in batches:
            for rows, texts in text_runs(batch, "text"):
                ids, offsets = encode(texts)
                lengths = np.diff(offsets) + 1
                ends = offsets_of(lengths)
                full = np.full(ends[-1], end_id, np.uint64)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), lengths - 1)] = ids
                yield pa.RecordBatch.from_arrays([pa.array([block_bytes(rows.column(0), lengths, full)], pa.binary())], names=["value"])

    rows = ordered.drop("__tie").mapInArrow(blocks, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", file_blocks).text(path)


_READ = "file string, place bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files below ``path``: ``doc_id, start, n_tokens, ids_crc32``, all taken from the files."""
    schema, arrow = typed(_READ)

    def decode(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                place = before = 0
                for doc_ids, lengths, ids in read_blocks(content.as_buffer()):
                    ends = offsets_of(lengths)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    n = len(lengths)
                    columns = [[file] * n, np.arange(place, place + n), doc_ids, before + ends[:-1], lengths, crc]
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, arrow)], schema=arrow
                    )
                    place, before = place + n, before + int(ends[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = stored(files.mapInArrow(decode, schema))
    # one row per file: part number, then the running number of the task's files
    files = stored(found.groupBy("file").agg(F.sum("n_tokens").alias("total"))).withColumns(
        {"part": F.regexp_extract("file", r"part-(\d+)-", 1).cast("int"), "turn": F.regexp_extract("file", r"-c(\d+)[^/]*$", 1).cast("int")}
    )
    before = Window.partitionBy("part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    summed = files.withColumn("inside", F.coalesce(F.sum("total").over(before), F.lit(0)))
    # one number per part, of which there are as many as tasks that wrote
    parts = files.groupBy("part").agg(F.sum("total").alias("total")).orderBy("part").collect()
    starts = offsets_of(np.array([r["total"] for r in parts], np.int64))[:-1].tolist()
    table = spark.createDataFrame([(r["part"], s) for r, s in zip(parts, starts)], "part int, first bigint")
    bases = stored(summed.join(F.broadcast(table), "part").select("file", (F.col("first") + F.col("inside")).alias("base")))
    return found.join(bases, "file").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def ids_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the ids of ``docs`` to files in the shared folder and returns what the files hold."""
    spark = docs.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer)
    return read_ids(spark, path)
