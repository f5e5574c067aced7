"""Compression of vectors to short codes: a codebook per part, trained by ball k-means over whole numbers.

The parts assigned to one entry form its ball; the ball's radius is the distance of its farthest part. Another entry can
be nearer to some part of the ball only if it lies within twice the radius: these are the ball's neighbours. Parts nearer
to their entry than half the way to the nearest neighbour are its stable core and are not compared with anything. The
others lie in rings: a part at distance d can only move to neighbours within 2d of its own entry, so each ring has its
own, exact list of candidates. All distances are squared whole numbers, so nothing rests on rounding.

In Spark every round is one pass over the rows, which carry their present entries; a task takes the balls of the rows it
holds at a time, whose radii are at most those of the whole balls. Sums per entry are combined in the tasks and
aggregated by Spark; the driver holds the codebooks, whose size doesn't depend on the table's.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tripleweave.llm.common import stored
from tripleweave.llm.vectors import usable

SCALE = 1024.0
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Ways that rows of one label are dealt out in the join with its sum.
LABEL_WAYS = 16
_LONG = (1 << 63) - 1


def part_bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts, equally wide if ``parts`` divides ``dim``."""
    cuts = [dim * k // parts for k in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def limit_of(dim: int) -> int:
    """The largest component for which four times a squared distance fits in a long."""
    return isqrt((1 << 58) // max(1, dim)) // 2


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole numbers, points by entries."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * max(1, points.shape[1]) * most * most < 1 << 53:  # then doubles hold every sum exactly
        a, b = points.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)
    out = np.zeros((len(points), len(entries)), np.int64)
    for k in range(points.shape[1]):
        out += (points[:, k, None] - entries[None, :, k]) ** 2
    return out


class Codebook:
    """Entries of one part, and for each entry all entries in the order of their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squared(entries, entries)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.away = np.take_along_axis(between, self.order, axis=1)
        self.compared = 0  # distances computed between parts and entries

    def assign_all(self, points: np.ndarray) -> np.ndarray:
        """The nearest entry of every point, the lowest index of equally near ones."""
        self.compared += len(points) * len(self.entries)
        return squared(points, self.entries).argmin(axis=1)

    def assign(self, points: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The same, given an entry ``own`` for each point from which it is not far."""
        out = own.copy()
        if not len(points) or len(self.entries) < 2:
            return out
        gap = points - self.entries[own]
        near = (gap * gap).sum(axis=1)
        self.compared += len(points)
        radius = np.zeros(len(self.entries), np.int64)
        np.maximum.at(radius, own, near)
        # an equally near entry of lower index counts, so only parts strictly inside half the way are stable
        moving = np.flatnonzero(4 * near >= self.away[own, 1])
        moving = moving[np.argsort(own[moving], kind="stable")]
        balls, firsts = np.unique(own[moving], return_index=True)
        for ball, inside in zip(balls.tolist(), np.split(moving, firsts[1:])):
            neighbours = int(np.searchsorted(self.away[ball], 4 * radius[ball], side="right"))
            ring = np.searchsorted(self.away[ball, :neighbours], 4 * near[inside], side="right")
            # rings are taken together up to the next power of two: a few more candidates, far fewer steps
            width = np.minimum(1 << np.ceil(np.log2(ring)).astype(np.int64), neighbours)
            for size in np.unique(width).tolist():
                at = inside[width == size]
                candidates = np.sort(self.order[ball, :size])  # the first of equal distances is the lowest index
                out[at] = candidates[squared(points[at], self.entries[candidates]).argmin(axis=1)]
                self.compared += len(at) * size
        return out


def _whole(vectors: DataFrame, dim: int, scale: float, carry: list[str]) -> DataFrame:
    """Rows of one dimension with components floor(scale * x), limited to what squared distances can hold."""
    most = float(limit_of(dim))
    # limited first: floor of a huge double is no long
    limited = lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(scale) * x.cast("double")))
    whole = F.transform("embedding", lambda x: F.floor(limited(x)).cast("bigint"))
    return vectors.filter(F.size("embedding") == dim).select("vec_id", *carry, whole.alias("__x"))


def _ints(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), width)


def _assigned(rows: DataFrame, books: list[Codebook], dim: int, first: bool) -> DataFrame:
    """Rows with ``__own``, each part's entry, and ``__error``; ``first`` if they have no entries yet."""
    bounds = part_bounds(dim, len(books))
    base = [f for f in rows.schema.fields if f.name not in ("__own", "__error")]
    out = StructType([*base, StructField("__own", ArrayType(IntegerType())), StructField("__error", LongType())])
    names = [f.name for f in base]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _ints(batch.column(batch.schema.names.index("__x")), dim)
            before = None if first else _ints(batch.column(batch.schema.names.index("__own")), len(books))
            own = np.empty((len(x), len(books)), np.int64)
            error = np.zeros(len(x), np.int64)
            for k, ((a, b), book) in enumerate(zip(bounds, books)):
                points = x[:, a:b]
                own[:, k] = book.assign_all(points) if first else book.assign(points, before[:, k])
                gap = points - book.entries[own[:, k]]
                error += (gap * gap).sum(axis=1)
            offsets = pa.array(np.arange(len(x) + 1) * len(books), pa.int32())
            codes = pa.ListArray.from_arrays(offsets, pa.array(own.ravel(), pa.int32()))
            columns = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, codes, pa.array(error)], names=out.names)

    return rows.mapInArrow(run, out)


def _moved(rows: DataFrame, books: list[Codebook], dim: int) -> list[Codebook]:
    """Codebooks with every entry at floor(mean) of its parts; entries without parts stay."""
    bounds = part_bounds(dim, len(books))
    count = len(books[0].entries)

    def sums(batches):
        total = np.zeros((len(books), count, dim // len(books) + 1), np.int64)
        held = np.zeros((len(books), count), np.int64)
        for batch in batches:
            x, own = _ints(batch.column(0), dim), _ints(batch.column(1), len(books))
            for k, (a, b) in enumerate(bounds):
                held[k] += np.bincount(own[:, k], minlength=count)
                np.add.at(total[k, :, : b - a], own[:, k], x[:, a:b])
        part, entry = np.nonzero(held)
        width = total.shape[2]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width), pa.int32()), pa.array(np.repeat(entry, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(part)), pa.int32()),
                pa.array(total[part, entry].ravel()), pa.array(np.repeat(held[part, entry], width)),
            ],
            names=["part", "entry", "place", "total", "held"],
        )

    partial = rows.select("__x", "__own").mapInArrow(sums, "part int, entry int, place int, total bigint, held bigint")
    whole = partial.groupBy("part", "entry", "place").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("held").alias("held")
    )
    entries = [book.entries.copy() for book in books]
    for r in whole.collect():  # one row per component of the codebooks
        if r["place"] < entries[r["part"]].shape[1]:
            entries[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["held"]
    return [Codebook(e) for e in entries]


def codebooks_digest(books: list[Codebook]) -> str:
    """Hexadecimal SHA-256 of all components by part, entry and place, in decimal with commas between."""
    text = ",".join(str(x) for book in books for x in book.entries.ravel().tolist())
    return hashlib.sha256(text.encode()).hexdigest()


def compress(
    vectors: DataFrame, carry: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE
) -> list[tuple[DataFrame, list[Codebook]]]:
    """For every dimension among ``vectors`` (``vec_id, embedding``) its rows ``vec_id, *carry, codes, error`` and codebooks.

    Components become floor(scale * x); beyond what lets squared distances fit in a long (``limit_of``: 32768 * scale for
    64 dimensions and a scale of 1024) they are limited to that. Vectors of one dimension share codebooks, one per part;
    they start as the parts of the ``entries`` rows of smallest vec_id (repeated vec_ids in the order of their vectors;
    fewer rows give fewer entries). Rows without a vec_id, and vectors that are null or hold null or non-finite
    components, are left out. Repeated rows count as often as they are there; an empty table gives an empty list.
    ``codes`` lists each part's entry, ``error`` is the sum of the parts' squared distances. Every round's rows are a
    written table, so lost executors repeat at most one round.
    """
    good = stored(vectors.filter(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("bigint").alias("vec_id"), *carry, "embedding"))
    dims = sorted(r["d"] for r in good.select(F.size("embedding").alias("d")).distinct().collect())
    out = []
    for dim in dims:
        rows = _whole(good, dim, scale, list(carry))
        start = np.array([r["__x"] for r in rows.select("vec_id", "__x").orderBy("vec_id", "__x").limit(entries).collect()], np.int64)
        books = [Codebook(start.reshape(len(start), dim)[:, a:b].copy()) for a, b in part_bounds(dim, parts)]
        for turn in range(rounds):
            rows = stored(_assigned(rows, books, dim, first=turn == 0))
            books = _moved(rows, books, dim)
        rows = stored(_assigned(rows, books, dim, first=rounds == 0))
        out.append((rows.select("vec_id", *carry, F.col("__own").alias("codes"), F.col("__error").alias("error")), books))
    return out


def coded(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row of ``vec_id, embedding, label``.

    ``code`` has two hexadecimal digits per part; ``label_error`` sums the errors of all rows with that label, null
    labels together (the largest long if the sum is beyond it); codebooks are those of the row's dimension.
    """
    found = None
    for rows, books in compress(vectors, ("label",)):
        code = F.concat_ws("", F.transform("codes", lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))))
        own = rows.select("vec_id", "label", code.alias("code"), "error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("bigint")
    sums = stored(found.groupBy("label").agg(total.alias("label_error")))
    # a label may have any share of the rows, so each label's rows go to several tasks
    ways = sums.withColumn("__way", F.explode(F.sequence(F.lit(0), F.lit(LABEL_WAYS - 1))))
    dealt = found.withColumn("__way", F.pmod(F.xxhash64("vec_id"), F.lit(LABEL_WAYS)).cast("int")).withColumnRenamed("label", "__label")
    joined = dealt.join(ways, dealt["__label"].eqNullSafe(ways["label"]) & (dealt["__way"] == ways["__way"]))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
