"""Exact top-k by inner product over whole numbers, with a KD-tree per shard."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.llm.common import stored, typed
from tripleweave.llm.vectors import blocks, doubles, usable

SCALE = 256.0
K = 5
SHARD_ROWS = 8192
QUERY_ROWS = 256
LEAF_ROWS = 128
#: Sums up to here are exact in doubles; larger ones are taken in Python's integers.
EXACT = float(1 << 53)


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256 * x), which a double holds exactly."""
    return np.floor(SCALE * vectors)


class KdTree:
    """Median splits along the widest dimension down to leaves; every node has its rows' tight box.

    Nodes are numbered as in a heap: the children of ``n`` are ``2n`` and ``2n + 1``.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        n, dim = rows.shape
        self.depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf_rows))))
        order = np.arange(n)
        nodes = 2 << self.depth
        self.start, self.end = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.low, self.high = np.zeros((nodes, dim)), np.zeros((nodes, dim))
        self.end[1] = n
        for node in range(1, nodes):
            a, b = self.start[node], self.end[node]
            own = rows[order[a:b]]
            if len(own):
                self.low[node], self.high[node] = own.min(axis=0, initial=np.inf), own.max(axis=0, initial=-np.inf)
            if 2 * node < nodes:
                middle = (a + b) // 2
                if b - a > 1 and dim:
                    widest = int((self.high[node] - self.low[node]).argmax())
                    order[a:b] = order[a:b][np.argpartition(own[:, widest], middle - a)]
                self.start[2 * node], self.end[2 * node], self.start[2 * node + 1], self.end[2 * node + 1] = a, middle, middle, b
        self.ids, self.rows = ids[order], rows[order]
        self.first_leaf = 1 << self.depth
        self.largest = float(np.abs(rows).max(initial=0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have with a row in each node's box."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int, least: list[float]) -> list[list[tuple[int, int]]]:
        """Per query the rows ``(score, vec_id)`` that may be among its k best, given that ``k`` rows elsewhere score
        ``least`` or more. Best-first: nodes in the order of their bounds, until the bound is under the kth score."""
        dim = self.rows.shape[1]
        exact = self.largest * float(np.abs(queries).max(initial=0)) * max(1, dim) < EXACT
        bounds = self.bounds(queries)
        # beyond exact sums a bound is only near: nothing within rounding of the kth score is left out
        slack = 0.0 if exact else (np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high)).max(axis=0, initial=0)) * dim * 1e-12
        out = []
        for q, own in enumerate(own_ids.tolist()):
            query, bound = queries[q], bounds[q]
            give = 0.0 if exact else float(slack[q])
            kth, best = least[q], []
            heap = [(-bound[1], 1)]
            while heap and -heap[0][0] >= kth - give:
                _, node = heapq.heappop(heap)
                a, b = int(self.start[node]), int(self.end[node])
                if a == b:
                    continue
                if node < self.first_leaf:
                    for child in (2 * node, 2 * node + 1):
                        if bound[child] >= kth - give:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                if exact:
                    scores = self.rows[a:b] @ query
                    near = np.flatnonzero(scores >= kth)
                    found = [(int(s), i) for s, i in zip(scores[near].tolist(), self.ids[a:b][near].tolist()) if i != own]
                else:
                    exact_query = [int(x) for x in query]
                    found = [
                        (sum(x * int(y) for x, y in zip(exact_query, row)), i)
                        for row, i in zip(self.rows[a:b].tolist(), self.ids[a:b].tolist()) if i != own
                    ]
                if found:
                    best = sorted(best + found, key=lambda x: (-x[0], x[1]))[:k]
                    if len(best) == k:
                        kth = max(kth, best[-1][0])
            out.append(best)
        return out


_FOUND = "qkey bigint, query_id bigint, vec_id bigint, score bigint"
_LONG = (1 << 63) - 1


def _searcher(k: int):
    def run(batches):
        _, arrow = typed(_FOUND)
        last, tree = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                n, ids, vecs, shard, qn, qids, qvecs, qblock, least = (c[row].as_py() for c in batch.columns)
                if last != shard:  # rows come sorted by shard
                    last, tree = shard, KdTree(np.frombuffer(ids, np.int64), whole(doubles(vecs, n)))
                queries, own = whole(doubles(qvecs, qn)), np.frombuffer(qids, np.int64)
                found = tree.search(queries, own, k, least or [-np.inf] * qn)
                flat = [(qblock << 20 | q, int(own[q]), i, max(-_LONG - 1, min(_LONG, s))) for q, best in enumerate(found) for s, i in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*flat) if flat else ((),) * 4)], schema=arrow)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qkey").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` the k rows of ``vectors`` with another vec_id and
    the largest inner product of floor(256 x), ties to the smaller vec_id. Both have ``vec_id, embedding``.

    Rows without a vec_id, or whose vector is null or holds null or non-finite components, take no part; vectors are
    compared with those of their own dimension. Repeated rows count as often as they are there, as queries too. Scores
    beyond a long become the largest or smallest one. Fewer candidates give fewer rows.

    Vectors are hashed into shards; queries come in blocks. First each block searches one shard, which gives every query
    a kth score; that is carried to all other shards, whose trees are only searched where a box can still reach it.
    """
    shards = blocks(_rows(vectors), shard_rows).withColumnRenamed("block", "shard")
    asked = blocks(_rows(queries), query_rows).select(
        "dim", F.col("block").alias("qblock"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vecs").alias("qvecs")
    )
    parts = stored(shards.groupBy("dim").agg(F.count(F.lit(1)).cast("int").alias("shards")))
    # blocks of different dimensions must differ in their numbers
    asked = asked.join(parts, "dim").withColumn("qblock", F.col("qblock").cast("bigint") * 4096 + F.pmod("dim", F.lit(4096)))
    columns = ["n", "ids", "vecs", "shard", "qn", "qids", "qvecs", "qblock", "least"]

    def visit(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(shards, ["dim", "shard"]).withColumn("shard", F.col("dim").cast("bigint") * (1 << 31) + F.col("shard"))
        return joined.select(*columns).sortWithinPartitions("shard").mapInArrow(_searcher(k), _FOUND)

    home = F.pmod(F.xxhash64("qblock"), F.col("shards")).cast("int")
    first = stored(visit(asked.withColumn("shard", home).withColumn("least", F.lit(None).cast("array<double>"))))
    kth = _best(first, k).filter(F.col("rank") == k).select(
        F.shiftright("qkey", 20).alias("qblock"), F.struct(F.col("qkey").bitwiseAND((1 << 20) - 1).cast("int").alias("q"), "score").alias("x")
    )
    listed = kth.groupBy("qblock").agg(F.collect_list("x").alias("kth"))
    bound = F.transform(
        F.sequence(F.lit(0), F.col("qn") - 1),
        lambda q: F.coalesce(F.element_at(F.map_from_entries("kth"), q).cast("double"), F.lit(float("-inf"))),
    )
    rest = asked.join(listed, "qblock", "left").withColumn("kth", F.coalesce("kth", F.array().cast("array<struct<q:int,score:bigint>>")))
    rest = rest.withColumn("least", bound).withColumn(
        "shard", F.explode(F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != home))
    )
    return _best(first.unionByName(visit(rest)), k).select("query_id", "rank", "vec_id", "score")


def _rows(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
