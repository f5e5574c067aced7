"""Approximate nearest neighbours by cosine: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.llm.common import stored, typed
from tripleweave.llm.kdtree import _rows
from tripleweave.llm.vectors import blocks, doubles, matrix
from tripleweave.operators.checkpoints import tasks_for

K = 5
BRANCHES = 8
#: Rows the tree is fitted on, about; the tree has at most a leaf for every few of them, however many rows there are.
SAMPLE_ROWS = 20_000
LEAF_SAMPLE = 48
#: Queries that the leaf visits are calibrated on, about, and the recall to reach on them.
CALIBRATION_QUERIES = 200
RECALL = 0.97
BLOCK_ROWS = 4096
QUERY_ROWS = 512
#: Lots of neighbouring leaves, at least, that a query is sent to once each, however many leaves it visits there.
LOTS = 32


@dataclass
class Tree:
    """Nodes with unit centroids; ``children`` of leaves are empty, ``leaf`` numbers them."""

    centroids: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def add(self, centroid: np.ndarray) -> int:
        self.centroids.append(centroid), self.children.append([]), self.leaf.append(-1)
        return len(self.children) - 1

    def finish(self) -> Tree:
        self.below = [np.stack([self.centroids[c] for c in own]) if own else None for own in self.children]
        return self

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """Each unit row's leaf: down to the nearest child at every node."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if not self.children[node]:
                out[own] = self.leaf[node]
            elif len(own):
                to = (rows[own] @ self.below[node].T).argmax(axis=1)
                todo += [(child, own[to == k]) for k, child in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in the order in which a queue of nodes, nearest centroid first, comes to them."""
        out: list[int] = []
        heap = [(0.0, 0)]
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            while self.children[node]:  # down to the nearest leaf; what is passed by waits in the queue
                near = -(self.below[node] @ query)
                best = int(near.argmin())
                for k, child in enumerate(self.children[node]):
                    if k != best:
                        heapq.heappush(heap, (float(near[k]), child))
                node = self.children[node][best]
            out.append(self.leaf[node])
        return out


def fit_tree(rows: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_SAMPLE, rounds: int = 8, seed: int = 7) -> Tree:
    """Spherical k-means of the unit ``rows``, again within each cluster, until clusters are small or don't part."""
    rng = np.random.default_rng(seed)
    tree = Tree()
    todo = [(tree.add(rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])), np.arange(len(rows)))]
    while todo:
        node, own = todo.pop()
        parts = []
        if len(own) > leaf_rows:
            points = rows[own]
            centroids = points[rng.choice(len(own), min(branches, len(own)), replace=False)]
            for _ in range(rounds):
                to = (points @ centroids.T).argmax(axis=1)
                for k in range(len(centroids)):
                    if (to == k).any():
                        mean = points[to == k].sum(axis=0)
                        centroids[k] = mean / max(np.linalg.norm(mean), 1e-300)
            to = (points @ centroids.T).argmax(axis=1)
            parts = [(centroids[k], own[to == k]) for k in range(len(centroids)) if (to == k).any()]
        if len(parts) < 2:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
            continue
        for centroid, inside in parts:
            child = tree.add(centroid)
            tree.children[node].append(child)
            todo.append((child, inside))
    return tree.finish()


def units(rows: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that very large and very small components don't overflow."""
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True, initial=0), 1e-300)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row summed in the same order, so that equal rows have equal scores."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))
    odd = ~np.isfinite(out)
    if odd.any():
        out[odd] = (units(rows[odd]) * units(query[None])).sum(axis=1)
    return out


def nearest(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """Each query's k nearest of these rows, ``(cosine, vec_id)``: a product of matrices finds who may be among them,
    and their cosines decide."""
    rough = units(queries) @ units(rows).T
    rough[own[:, None] == ids[None, :]] = -np.inf
    out = []
    for q in range(len(queries)):
        line = rough[q]
        if len(line) > k:
            kth = np.partition(line, len(line) - k)[len(line) - k]
            near = np.flatnonzero((line >= kth - 1e-9) & (line > -np.inf))
        else:
            near = np.flatnonzero(line > -np.inf)
        scores = cosines(rows[near], queries[q])
        order = np.lexsort((ids[near], -scores))[:k]
        out.append([(float(scores[j]), int(ids[near[j]])) for j in order])
    return out


_FOUND = "qkey bigint, query_id bigint, vec_id bigint, score double"


def _flat(rows, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qkey").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fit_on_sample(rows: DataFrame, count: int, sample_rows: int = SAMPLE_ROWS) -> Tree:
    """The tree of a sample of about ``sample_rows`` rows, chosen by hash and held on the driver."""
    place = F.pmod(F.xxhash64(F.lit("tree"), "vec_id"), F.lit(1 << 30))
    share = min(1.0, sample_rows / max(1, count))
    sample = rows.filter(place < int(share * (1 << 30))).select("embedding").toArrow()
    return fit_tree(units(matrix(sample.column(0).combine_chunks())))


def approximate_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its k nearest found among the rows of ``vectors``
    with another vec_id, by cosine in double precision, ties to the smaller vec_id. Both have ``vec_id, embedding``.

    Rows without a vec_id, and vectors that are null, zero or hold null or non-finite components take no part; vectors
    are compared with those of their own dimension. Repeated rows count as often as they are there.

    Every row is put into its leaf; leaves are stored in blocks, large ones in several. Queries visit as many leaves as
    it takes to find ``recall`` of the true neighbours of a sample of queries, which are searched in all blocks; if
    fewer than k rows lie in those leaves, a query goes on to all. Fewer candidates than k give fewer rows.
    """
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows, asked = stored(_rows(vectors).filter(nonzero)), stored(_rows(queries).filter(nonzero))
    dims = [r["d"] for r in asked.select(F.size("embedding").alias("d")).distinct().collect()]
    found = None
    for dim in sorted(dims):
        own, mine = rows.filter(F.size("embedding") == dim), asked.filter(F.size("embedding") == dim)
        part = _search(own, mine, k, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return found


def _search(rows: DataFrame, asked: DataFrame, k: int, recall: float) -> DataFrame:
    count = rows.count()
    tree = fit_on_sample(rows, count)

    def assign(batches):
        for batch in batches:
            leaf = tree.leaf_of(units(matrix(batch.column(1)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "embedding", "leaf"])

    bins = blocks(rows.mapInArrow(assign, "vec_id bigint, embedding array<double>, leaf int"), BLOCK_ROWS, ["leaf"])
    numbered = stored(asked.withColumn("qkey", F.monotonically_increasing_id()))
    total = numbered.count()
    share = min(1.0, CALIBRATION_QUERIES / max(1, total))
    tried = numbered.filter(F.pmod(F.xxhash64(F.lit("try"), "qkey"), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()
    if not tried.num_rows:
        tried = numbered.limit(CALIBRATION_QUERIES).toArrow()
    tried_ids, tried_rows = tried.column("vec_id").to_numpy(), matrix(tried.column("embedding").combine_chunks())
    schema, arrow = typed("qkey bigint, leaf int, vec_id bigint, score double")

    def exact(batches):
        for batch in batches:
            for leaf, n, ids, vecs in zip(*(batch.column(c).to_pylist() for c in range(4))):
                best = nearest(np.frombuffer(ids, np.int64), doubles(vecs, n), tried_rows, tried_ids, k)
                yield _flat([(q, leaf, i, s) for q, own in enumerate(best) for s, i in own], arrow)

    truth = _best(bins.select("leaf", "n", "ids", "vecs").mapInArrow(exact, schema), k).select("qkey", "leaf").collect()
    seen = {q: {leaf: at for at, leaf in enumerate(tree.visits(v, tree.leaves))} for q, v in enumerate(units(tried_rows))}
    needed = np.sort([seen[r["qkey"]][r["leaf"]] + 1 for r in truth])  # visits after which each true neighbour is found
    visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else tree.leaves
    return _visit(numbered, bins, tree, visits, k)


def _visit(numbered: DataFrame, bins: DataFrame, tree: Tree, visits: int, k: int) -> DataFrame:
    found = stored(_best(_search_lots(numbered, bins, tree, visits, k), k))
    if visits < tree.leaves:  # queries whose leaves held fewer than k rows visit all
        full = found.filter(F.col("rank") == k).select("qkey")
        short = stored(numbered.join(full, "qkey", "left_anti"))
        if short.isEmpty():
            return found.select("query_id", "rank", "vec_id", "score")
        found = found.join(short.select("qkey"), "qkey", "left_anti").unionByName(_best(_search_lots(short, bins, tree, tree.leaves, k), k))
    return found.select("query_id", "rank", "vec_id", "score")


def _lots(tree: Tree, tasks: int) -> int:
    """How many lots the leaves make that queries are sent to; neighbouring leaves lie in one lot."""
    return min(tree.leaves, max(LOTS, tasks))


def _packed(queries: DataFrame, tree: Tree, most: int, lots: int) -> DataFrame:
    """Queries with the leaves that they visit, put together by lot of leaves; each comes to a lot once, with all it visits there.

    ``seen`` has a byte per query and leaf of the lot, ``low`` is the lot's first leaf.
    """
    starts = -(-np.arange(lots + 1) * tree.leaves // lots)  # the first leaf of each lot
    schema, arrow = typed("lot int, part int, qkey bigint, query_id bigint, embedding array<double>, seen binary")

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                of, lot, seen = [], [], []
                for q, v in enumerate(units(matrix(few.column(1)))):
                    here = np.zeros(tree.leaves, np.uint8)
                    here[tree.visits(v, most)] = 1
                    for g in np.flatnonzero(np.add.reduceat(here, starts[:-1])):
                        of.append(q), lot.append(g), seen.append(here[starts[g] : starts[g + 1]].tobytes())
                of = pa.array(of, pa.int64())
                keys = few.column(2).take(of)
                part = pa.array(np.asarray(keys) // QUERY_ROWS % (1 << 30), pa.int32())
                columns = [pa.array(lot, pa.int32()), part, keys, few.column(0).take(of), few.column(1).take(of), pa.array(seen, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def pack(key, table):
        rows, g = matrix(table.column("embedding").combine_chunks()), key[0].as_py()
        return pa.table({
            "lot": pa.array([g], pa.int32()), "low": pa.array([starts[g]], pa.int32()), "qn": pa.array([len(rows)], pa.int32()),
            "qkeys": [table.column("qkey").to_numpy().tobytes()], "qids": [table.column("query_id").to_numpy().tobytes()],
            "qvecs": [rows.tobytes()], "seen": [b"".join(table.column("seen").to_pylist())],
        })

    routed = queries.select("vec_id", "embedding", "qkey").mapInArrow(route, schema)
    return routed.groupBy("lot", "part").applyInArrow(pack, "lot int, low int, qn int, qkeys binary, qids binary, qvecs binary, seen binary")


def _meetings(queries: DataFrame, bins: DataFrame, tree: Tree, most: int) -> DataFrame:
    """Blocks of leaves with the packs of queries that come to their lot.

    Sorted and merged: packs grow out of rows that each become many, which size estimates do not see, so neither side may be
    taken for small and sent whole to the driver. A task holds the packs of a lot and streams the blocks.
    """
    lots = _lots(tree, tasks_for(queries.sparkSession))
    placed = bins.select((F.col("leaf") * lots / tree.leaves).cast("int").alias("lot"), "leaf", "n", "ids", "vecs")
    packed = _packed(queries, tree, most, lots)
    joined = placed.hint("merge").join(packed.hint("merge"), "lot")
    return joined.select("leaf", "n", "ids", "vecs", "low", "qn", "qkeys", "qids", "qvecs", "seen")


def _search_lots(queries: DataFrame, bins: DataFrame, tree: Tree, most: int, k: int) -> DataFrame:
    _, out = typed(_FOUND)

    def search(batches):
        for batch in batches:
            for at in range(batch.num_rows):  # rows hold large blocks, so one at a time
                leaf, n, ids, vecs, low, qn, qkeys, qids, qvecs, seen = (c[at].as_py() for c in batch.columns)
                come = np.flatnonzero(np.frombuffer(seen, np.uint8).reshape(qn, -1)[:, leaf - low])
                if not len(come):
                    continue
                keys, own = np.frombuffer(qkeys, np.int64)[come], np.frombuffer(qids, np.int64)[come]
                best = nearest(np.frombuffer(ids, np.int64), doubles(vecs, n), doubles(qvecs, qn)[come], own, k)
                yield _flat([(int(keys[q]), int(own[q]), i, s) for q, found in enumerate(best) for s, i in found], out)

    return _meetings(queries, bins, tree, most).mapInArrow(search, _FOUND)
