"""Near copies by the Jaccard similarity of word shingles, as links between the texts' SimHash fingerprints.

Texts meet if all least hashes of one of BANDS sets of BAND_HASHES hash functions agree, sets drawn from HASHES functions:
two texts of similarity 0.8 miss each other with a chance of 0.002, of 0.83 with 0.0003, of 0.86 with 0.00003; a text is
left over only if it misses all of its like. Sets are long, so that texts that merely share a passage seldom meet: at a
similarity of 0.3 with a chance of 0.004. Equal texts count once.

Texts that meet in a band are compared with its leaders: the first few texts not yet similar to one, against the whole
band, twice as many in each round, until every text leads or is similar to a leader. That takes leaders times texts
comparisons, not texts times texts, and no text is left out. Two texts of different leaders may still be similar; then
either is at most twice the allowed distance from the other's leader (Jaccard distance is a metric). Leaders' distances
are known, so just such texts, of leaders that have no text in common, are compared at the end.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.llm.common import stored, text_runs
from tripleweave.llm.simhash import fingerprint
from tripleweave.operators.skew import dealt_join

SHINGLE_WORDS = 5
#: Least similarity in fifths, and the least that a text has with the leader of a text similar to it.
LEAST, NEARBY = 4, 3
HASHES = 96
BANDS = 64
BAND_HASHES = 8
#: Leaders per band in the first round.
LEADERS = 4
#: Shingles that are hashed anew by all functions at a time.
AT_ONCE = 2048

_FACTORS = np.random.default_rng(5).integers(0, 2**63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_JOINS = np.random.default_rng(8).integers(0, 2**63, (BANDS, BAND_HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SETS = np.argsort(np.random.default_rng(13).random((BANDS, HASHES)), axis=1)[:, :BAND_HASHES]


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the text's different shingles; words as in ``simhash.fingerprint``, none without a word."""
    data = b" ".join(text.encode("utf-8").lower().split())
    if not data:
        return np.zeros(0, np.uint64)
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(data)]
    view, digest = memoryview(data), xxhash.xxh3_64_digest
    if len(starts) <= SHINGLE_WORDS:
        found = [digest(data)]
    else:
        found = [digest(view[a:b]) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :])]
    return np.unique(np.frombuffer(b"".join(found), ">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band, from the least values of its hash functions over all shingles."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        np.minimum(least, (hashes[None, at : at + AT_ONCE] * _FACTORS).min(axis=1), out=least)
    mixed = (least ^ least >> np.uint64(29))[_SETS] * _JOINS
    return np.bitwise_xor.reduce(mixed ^ mixed >> np.uint64(31), axis=1)


def fifths(a: np.ndarray, b: np.ndarray) -> int:
    """The similarity of two shingle sets in fifths, rounded down."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 5 // max(1, len(a) + len(b) - both)


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, node, fp, bands`` of every row, stored: 128 bits that stand for the text, its fingerprint, and its bands
    (none without a word). Every text is read once for all that near dedup needs."""
    schema = "doc_id bigint, node binary, fp bigint, bands array<bigint>"
    kind = pa.list_(pa.int64())

    def scan(batches):
        for batch in batches:
            for rows, texts in text_runs(batch, "text"):
                own = texts.to_pylist()
                prints = np.array([fingerprint(t) for t in own], np.uint64).view(np.int64)
                grams = [shingles(t) for t in own]
                bands = pa.array([band_keys(h).view(np.int64) if len(h) else [] for h in grams], kind)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(prints), bands], names=["doc_id", "node", "fp", "bands"])

    return stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _node().alias("node"), "text").mapInArrow(scan, schema))


def _node():
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, grams`` of the given nodes, stored."""
    texts = docs.select(_node().alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    # stored before equal texts are put together, so that a text of very many rows can be split in the join
    held = stored(texts.join(nodes, "node", "left_semi")).dropDuplicates(["node"])

    def sets(batches):
        for batch in batches:
            for rows, runs in text_runs(batch, "text"):
                grams = pa.array([shingles(t).tobytes() for t in runs.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), grams], names=["node", "grams"])

    return stored(held.select("node", "text").mapInArrow(sets, "node binary, grams binary"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, level`` of different pairs whose similarity is NEARBY fifths or more, stored."""
    sides = [sets.select(F.col("node").alias(n), F.col("grams").alias(f"grams_{n}")) for n in "ab"]

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            of = lambda column, row: np.frombuffer(column[row].as_buffer(), np.uint64)
            level = np.array([fifths(of(left, row), of(right, row)) for row in range(batch.num_rows)], np.int32)
            near = pa.array(level >= NEARBY)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near), pa.array(level).filter(near)], names=["a", "b", "level"])

    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "grams_a", "grams_b")
    return stored(both.mapInArrow(run, "a binary, b binary, level int"))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a != b").distinct()


def _both_ways(found: DataFrame) -> DataFrame:
    """``x, y, level`` with either end first."""
    there = found.select(F.col("a").alias("x"), F.col("b").alias("y"), "level")
    return there.unionByName(found.select(F.col("b").alias("x"), F.col("a").alias("y"), "level"))


def node_links(rows: DataFrame, docs: DataFrame, leaders: int = LEADERS) -> DataFrame:
    """Similar pairs ``(a, b)`` of nodes that hang together as all similar pairs that meet in some band do.

    ``rows`` is ``described(docs)``.
    """
    spread = rows.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    counted = spread.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band")))
    members = stored(counted.filter("n > 1").select("node", "band"))
    sets = _shingle_sets(docs, stored(members.select("node").distinct()))
    first = Window.partitionBy("band").orderBy("node")
    rest, width = members, leaders
    compared, led = [], []
    while True:
        chosen = rest.withColumn("turn", F.row_number().over(first)).filter(F.col("turn") <= width)
        heads = stored(chosen.select("band", F.col("node").alias("head")))
        pairs = _pairs(dealt_join(members, heads, ["band"]), "node", "head")
        for before in compared:
            pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
        compared.append(_compared(stored(pairs), sets))
        led.append(heads)
        similar = _both_ways(reduce(DataFrame.unionByName, compared)).filter(F.col("level") >= LEAST)
        taken = heads.join(similar.select(F.col("y").alias("head"), F.col("x").alias("node")), "head").select("band", "node").distinct()
        rest = rest.join(heads.withColumnRenamed("head", "node"), ["band", "node"], "left_anti")
        rest = stored(rest.join(taken, ["band", "node"], "left_anti"))
        if rest.isEmpty():
            break
        width *= 2

    found = reduce(DataFrame.unionByName, compared)
    heads = stored(reduce(DataFrame.unionByName, led).select(F.col("head").alias("y")).distinct())
    by_head = stored(_both_ways(found).join(heads, "y", "left_semi"))
    own = by_head.filter(F.col("level") >= LEAST).select("x", F.col("y").alias("own"))
    near = by_head.filter(F.col("level") < LEAST).select("x", F.col("y").alias("other"))
    joined = own.toDF("x", "own").join(own.toDF("x", "other"), "x").select("own", "other").distinct()
    between = stored(own.join(near, "x").join(joined, ["own", "other"], "left_anti"))
    turned = between.select(F.col("x").alias("z"), F.col("own").alias("other"), F.col("other").alias("own"))
    open_pairs = _pairs(between.join(turned, ["own", "other"]), "x", "z")
    late = _compared(stored(open_pairs.join(found.select("a", "b"), ["a", "b"], "left_anti")), sets)
    return found.unionByName(late).filter(F.col("level") >= LEAST).select("a", "b")


def links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of fingerprints of texts whose shingles are similar; ``docs`` has ``text``, null is empty, and
    ``rows`` is ``described(docs)``."""
    prints = stored(rows.select("node", "fp").distinct())
    pairs = node_links(rows, docs)
    for n in "ab":
        pairs = pairs.join(prints.select(F.col("node").alias(n), F.col("fp").alias(f"fp_{n}")), n)
    return pairs.filter("fp_a != fp_b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()
