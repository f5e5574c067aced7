"""Substring dedup over sliding sentence spans: runs of sentences that occur before in another place are removed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tripleweave.llm.common import stored, text_runs

#: A span is at least so many sentences, and as many more as it takes to have so many words.
SPAN_SENTENCES = 2
SPAN_WORDS = 25
#: A clause of at least so many words is cut at words that its text chooses, every CUT_EVERY words on average and after
#: as many words at most, so that passages without punctuation meet wherever they stand; alone it is a span, too.
CLAUSE_WORDS = 25
CUT_EVERY = 8

#: Sentences end with . ! ? (and closing quotes or brackets) before white space, or with a line. Their clauses, which
#: end with , ; or : there, count as sentences of their own, so that a passage's cut-off ends are short.
_END = re.compile(r"[.!?,;:]+[\"')\]]*\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")

_digest, _run_digest = xxhash.xxh3_128_digest, xxhash.xxh3_128_intdigest

#: Documents without an id come last in the order of occurrences, as one document.
_LAST = (1 << 63) - 1


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the text's sentences, each with what ends it and the white space behind; together they are the text."""
    cuts = [m.end() for m in _END.finditer(text)]
    cuts = [0, *cuts] if cuts and cuts[-1] == len(text) else [0, *cuts, len(text)]
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= 2 * CLAUSE_WORDS - 1 and len(text[a:b].split()) >= CLAUSE_WORDS:
            out += _pieces(text, a, b)
        else:
            out.append((a, b))
    return out


def _pieces(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """The clause cut where two words' hash says so, or CLAUSE_WORDS after the last cut."""
    out, held, before = [], 0, b""
    low = start
    for m in _WORD.finditer(text, start, stop):
        word = m[0].strip().lower().encode("utf-8", "surrogatepass")
        held += 1
        if m.end() < stop and (held == CLAUSE_WORDS or before and xxhash.xxh3_64_intdigest(before + b" " + word) % CUT_EVERY == 0):
            out.append((low, m.end()))
            low, held = m.end(), 0
        before = word
    return [*out, (low, stop)]


def spans(text: str, least: int = SPAN_SENTENCES, words: int = SPAN_WORDS) -> tuple[list, list[tuple[int, int]], list[int]]:
    """The sentences; the spans ``(first, end)`` of sentence numbers; and a 128-bit hash of each span's words.

    From every sentence on, the shortest run of at least ``least`` sentences and ``words`` words; words in lower case,
    white space between them doesn't count. Near the end, where there is no such run, none begins, but the shortest
    one that reaches the end is a span; a whole text of fewer words is one, too, if it has ``least`` sentences, and so is a
    clause of CLAUSE_WORDS words.
    """
    cut = sentences(text)
    marked = "\0".join([text[a:b] for a, b in cut] if "\0" not in text else [text[a:b].replace("\0", " ") for a, b in cut])
    plain = " ".join(marked.lower().split()).replace(" \0", "\0").replace("\0 ", "\0").split("\0")
    counts = [p.count(" ") + 1 if p else 0 for p in plain]
    keys = [_digest(p.encode("utf-8", "surrogatepass")) for p in plain]
    n = len(cut)
    out, hashes = [], []
    end = held = 0
    for k in range(n):  # [k, end) moves over the sentences, with ``held`` words in it
        while end < n and (held < words or end - k < least):
            held += counts[end]
            end += 1
        if held < words or end - k < least:
            break
        if counts[k]:  # a run that begins with a blank sentence says no more than the one behind it
            out.append((k, end))
            hashes.append(_run_digest(b"".join(keys[k:end])))
        held -= counts[k]
    first, held = n, 0
    while first and (held < words or n - first < least):
        first -= 1
        held += counts[first]
    # a text too short for a run counts as a whole, which meets only texts of the same words
    last = [(first, n)] if held and n - first >= least and (not out or out[-1] != (first, n)) else []
    for a, b in [*last, *((k, k + 1) for k in range(n) if counts[k] >= CLAUSE_WORDS)]:
        out.append((a, b))
        hashes.append(_run_digest(b"".join(keys[a:b])))
    return cut, out, hashes


def _halves(value: int) -> tuple[int, int]:
    return (value >> 64) - (1 << 63), (value & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def span_hashes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``__doc`` (doc_id, null as the last), ``__text`` (hash of the text) and the different
    ``__hashes`` of its spans, each two longs."""
    pair = StructType([StructField("h", LongType()), StructField("g", LongType())])
    schema = StructType([StructField("__doc", LongType()), StructField("__text", LongType()), StructField("__hashes", ArrayType(pair))])
    kind = pa.list_(pa.struct([("h", pa.int64()), ("g", pa.int64())]))

    def scan(batches):
        for batch in batches:
            for rows, texts in text_runs(batch, "text"):
                found = [list(dict.fromkeys(map(_halves, spans(t)[2]))) for t in texts.to_pylist()]
                flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["h", "g"])
                lists = pa.ListArray.from_arrays(pa.array(ends), values).cast(kind)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists], names=["__doc", "__text", "__hashes"])

    keyed = docs.select(*_keys(), "text")
    return keyed.mapInArrow(scan, schema)


def _keys():
    return (
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("__doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text"),
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``__doc, __text, __gone``: per document the hashes of its spans that occur in a document with a lesser doc_id.

    Each hash's first document is aggregated as one number, map side first, and only hashes of several documents are
    kept; they are joined back to the occurrences, where a passage of very many documents can be split by rows.
    """
    seen = stored(span_hashes(docs))
    each = seen.select("__doc", "__text", F.explode("__hashes").alias("x")).select("__doc", "__text", "x.h", "x.g")
    several = stored(
        each.groupBy("h", "g").agg(F.min("__doc").alias("first"), F.max("__doc").alias("last")).filter("first < last").drop("last")
    )
    gone = each.join(several, ["h", "g"]).filter("__doc > first")
    return stored(gone.groupBy("__doc", "__text").agg(F.collect_set(F.struct("h", "g")).alias("__gone")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with two more columns, ``clean_text`` and ``removed`` (spans of characters taken from ``text``).

    A sentence goes if a span over it has occurred before: in a document with a lesser doc_id, or earlier in the same
    text. Rows that share a doc_id, and rows without one, count as one document each, so what only they share stays.
    Null text stays null, and clean texts stay as they are. Columns of these two names are replaced.
    """
    repeated = repeated_spans(docs)
    plain = docs.drop("clean_text", "removed")
    keyed = plain.withColumns(dict(zip(("__doc", "__text"), _keys())))
    joined = keyed.join(repeated, ["__doc", "__text"], "left")
    names = [*plain.columns]
    at, gone_at = names.index("text"), len(names)
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*plain.schema.fields, StructField("clean_text", plain.schema["text"].dataType), StructField("removed", ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def clean(batches):
        for batch in batches:
            texts, removed = [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(gone_at).to_pylist()):
                cleaned, holes = cut_spans(text, {(x["h"], x["g"]) for x in gone or ()}) if text else (text, [])
                texts.append(cleaned)
                removed.append([{"start": a, "end": b} for a, b in holes])
            columns = [*batch.columns[:gone_at], pa.array(texts, pa.string()), pa.array(removed, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "clean_text", "removed"])

    return joined.select(*names, "__gone").mapInArrow(clean, schema)


def cut_spans(text: str, gone: set[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the sentences of spans in ``gone`` or repeated within it, and the removed character spans."""
    cut, runs, hashes = spans(text)
    drop = np.zeros(len(cut) + 1, np.int64)
    own: set[int] = set()
    for (first, end), value in zip(runs, hashes):
        if _halves(value) in gone or value in own:
            drop[first] += 1
            drop[end] -= 1
        else:
            own.add(value)
    dropped = np.cumsum(drop)[:-1] > 0
    if not dropped.any():
        return text, []
    kept = "".join(text[a:b] for (a, b), d in zip(cut, dropped.tolist()) if not d)
    holes: list[tuple[int, int]] = []
    for (a, b), d in zip(cut, dropped.tolist()):
        if d:
            if holes and holes[-1][1] == a:
                holes[-1] = (holes[-1][0], b)
            else:
                holes.append((a, b))
    return kept, holes
