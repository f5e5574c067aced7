"""Near-duplicate vectors by cosine through an inverted multi-index.

The halves of unit vectors have a codebook each; an entry of either makes a cell of a product grid, and every vector lies
in the cell of its halves' nearest entries. A vector visits cells in the order of the sum of both halves' distances
(multi-sequence traversal: a queue holds the next cell of each row and column begun) until the calibrated number.
Two vectors meet if either visits the other's cell; those that meet are verified by their cosine.

Copies make no pairs. The vectors of a cell are first put together around leaders: all within ``BALL`` of a leader are
linked with each other for sure. Only leaders travel. Between two balls, the angle of the leaders and the balls' radii
decide for all members at once, except near the threshold, where members are compared one by one. Links are counted where
they are found, and what goes on to the components is at most one link per ball and task.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.common import stored, typed
from tripleweave.llm.components import components
from tripleweave.llm.kmeans_tree import units
from tripleweave.llm.vectors import blocks, doubles, matrix, usable

LEAST = 0.9
#: Least cosine of a ball's members with its leader: any two are then within twice that angle, 0.96 by cosine.
BALL = 0.99
#: Rows that the codebooks are fitted on, about, and the rows of a cell, about, until there are MOST_ENTRIES a half.
SAMPLE_ROWS = 20_000
CELL_ROWS = 256
MOST_ENTRIES = 64
#: Leaders that the number of visits is calibrated on, about, and the share of links to find.
CALIBRATION = 200
RECALL = 0.995
BLOCK_ROWS = 4096
HELD_ROWS = 2048
QUERY_ROWS = 512
#: Slack of angles that are decided without the exact cosine.
SLACK = 1e-6


@dataclass
class Grid:
    """Codebooks of the two halves of unit vectors."""

    first: np.ndarray
    second: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def _gaps(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each half from its entries, summed row by row so that equal rows have equal ones."""
        half = self.first.shape[1]
        of = lambda x, book: np.stack([((x - entry) ** 2).sum(axis=1) for entry in book], axis=1)
        return of(rows[:, :half], self.first), of(rows[:, half:], self.second)

    def traversals(self, rows: np.ndarray, most: int) -> np.ndarray:
        """Each row's first ``most`` cells, nearest first."""
        a, b = self._gaps(rows)
        by_a, by_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, by_a, axis=1), np.take_along_axis(b, by_b, axis=1)
        out = np.empty((len(rows), min(most, self.cells)), np.int32)
        for r in range(len(rows)):
            out[r] = multi_sequence(a[r].tolist(), b[r].tolist(), by_a[r].tolist(), by_b[r].tolist(), out.shape[1])
        return out


def multi_sequence(a: list[float], b: list[float], by_a: list[int], by_b: list[int], most: int) -> list[int]:
    """The ``most`` cells of least ``a[i] + b[j]`` for ascending a and b, as ``by_a[i] * len(b) + by_b[j]``.

    A cell enters the queue once the cells before it in its row and in its column have left it.
    """
    width, out = len(b), []
    heap, left = [(a[0] + b[0], 0, 0)], [0] * len(a)  # left[i]: cells of row i that have left the queue
    while len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append(by_a[i] * width + by_b[j])
        left[i] = j + 1
        if i + 1 < len(a) and left[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < width and (i == 0 or left[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


def _codebook(rows: np.ndarray, entries: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    book = distinct[rng.choice(len(distinct), min(entries, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = ((book * book).sum(axis=1)[None] - 2 * rows @ book.T).argmin(axis=1)
        for k in np.unique(near):
            book[k] = rows[near == k].mean(axis=0)
    return book


def fit_grid(rows: np.ndarray, count: int, cell_rows: int = CELL_ROWS) -> Grid:
    """Codebooks from a sample's unit ``rows`` for a table of ``count`` rows."""
    half = rows.shape[1] // 2
    entries = int(min(MOST_ENTRIES, max(2, round((count / cell_rows) ** 0.5))))
    return Grid(_codebook(rows[:, :half], entries, 3), _codebook(rows[:, half:], entries, 4))


def cosine_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of ``a`` with the same rows of ``b`` in double precision."""
    with np.errstate(all="ignore"):
        out = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    odd = ~np.isfinite(out)
    if odd.any():
        out[odd] = (units(a[odd]) * units(b[odd])).sum(axis=1)
    return out


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have a cosine of at least ``least``; close calls by the exact sum of each pair."""
    unit_a, unit_b = units(a), units(b)
    rough = unit_a @ unit_b.T
    found = rough >= least
    i, j = np.nonzero(np.abs(rough - least) < 1e-9)
    if len(i):
        found[i, j] = cosine_pairs(a[i], b[j]) >= least
    return found


def leader_balls(rows: np.ndarray, ball: float = BALL) -> tuple[np.ndarray, np.ndarray]:
    """``leader`` of every row (a row's number) and every row's angle to it: the first row not yet taken leads, and takes
    all rows left within ``ball``. A row's leader is the first leader that it is near to."""
    unit = units(rows)
    leader, angle = np.full(len(rows), -1, np.int64), np.zeros(len(rows))
    rest = np.arange(len(rows))
    # rows that are near to nothing lead themselves; found at once, so that scattered rows need no step each
    for low in range(0, len(rows), 1024):
        part = unit[low : low + 1024] @ unit.T >= ball - 1e-12
        alone = low + np.flatnonzero(part.sum(axis=1) == 1)
        leader[alone] = alone
    rest = rest[leader < 0]
    while len(rest):
        head = rest[0]
        cosine = unit[rest] @ unit[head]
        inside = cosine >= ball
        inside[0] = True
        leader[rest[inside]] = head
        angle[rest[inside]] = np.arccos(np.clip(cosine[inside], -1, 1))
        rest = rest[~inside]
    angle[leader == np.arange(len(rows))] = 0
    return leader, angle


def forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node reachable from each of ``nodes`` over the edges ``a - b``."""
    root = np.arange(nodes)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while not (root[root] == root).all():
            root = root[root]
    return root


def _each(batch: pa.RecordBatch):
    """Rows one at a time, as they may hold large blocks."""
    for row in range(batch.num_rows):
        yield [c[row].as_py() for c in batch.columns]


_BALL = "key bigint, cell int, size int, radius double, first bigint, ids binary, leader binary, members binary"


def _balls(cells: DataFrame, ball: float) -> DataFrame:
    """One row per ball: its number, cell, members and angle of the farthest, least vec_id, leader and member vectors
    (empty for a ball of equal or single vectors, which its leader stands for)."""
    # a number's parts, task and block, moved apart to make room for a block's balls
    number = F.monotonically_increasing_id()
    base = F.shiftleft(F.shiftright(number, 33), 40).bitwiseOR(F.shiftleft(number.bitwiseAND((1 << 24) - 1), 16))
    numbered = cells.withColumn("base", base)
    schema, arrow = typed(_BALL)

    def run(batches):
        for batch in batches:
            for base, cell, n, ids, vecs in _each(batch):
                own, rows = np.frombuffer(ids, np.int64), doubles(vecs, n)
                leader, angle = leader_balls(rows, ball)
                order = np.argsort(leader, kind="stable")
                heads, firsts = np.unique(leader[order], return_index=True)
                out = []
                for number, (head, inside) in enumerate(zip(heads.tolist(), np.split(order, firsts[1:]))):
                    same = len(inside) == 1 or (rows[inside] == rows[head]).all()
                    radius = 0.0 if same else float(angle[inside].max())
                    members = b"" if same else rows[inside].tobytes()
                    out.append((base + number, cell, len(inside), radius, int(own[inside].min()), own[inside].tobytes(), rows[head].tobytes(), members))
                for low in range(0, len(out), 512):
                    columns = list(zip(*out[low : low + 512]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return stored(numbered.select("base", "cell", "n", "ids", "vecs").mapInArrow(run, schema))


_PACK = "cell int, n int, keys binary, sizes binary, radii binary, vecs binary, homes binary, ways binary"


def _packs(travellers: DataFrame, rows: int, salt: int) -> DataFrame:
    """Travelling leaders put together by the cell they come to, ``rows`` about at a time; hot cells make several."""
    counts = stored(travellers.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows)).cast("int").alias("parts")))
    dealt = travellers.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("key", F.lit(salt)), F.col("parts")).cast("int"))

    def pack(key, table):
        join = lambda name: [b"".join(table.column(name).to_pylist())]
        flat = lambda name: [table.column(name).to_numpy().tobytes()]
        return pa.table({
            "cell": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([table.num_rows], pa.int32()), "keys": flat("key"), "sizes": flat("size"),
            "radii": flat("radius"), "vecs": join("leader"), "homes": flat("home"), "ways": join("ways"),
        })

    return dealt.select("cell", "part", "key", "size", "radius", "leader", "home", "ways").groupBy("cell", "part").applyInArrow(pack, _PACK)


@dataclass
class _Pack:
    keys: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    rows: np.ndarray
    homes: np.ndarray
    ways: np.ndarray

    @classmethod
    def of(cls, n: int, keys: bytes, sizes: bytes, radii: bytes, vecs: bytes, homes: bytes, ways: bytes) -> _Pack:
        return cls(
            np.frombuffer(keys, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(radii, np.float64),
            doubles(vecs, n), np.frombuffer(homes, np.int32), np.frombuffer(ways, np.int32).reshape(n, -1),
        )


def compare_packs(asked: _Pack, held: _Pack, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``asked`` leaders that visit a cell against the leaders ``held`` there.

    Gives links ``(key, n)``: members that each ball gains here; ``(a, b)``: balls that hang together, one row per ball
    at most; and ``(a, b)``: pairs of balls whose members must be compared. A pair that meets in the other one's visit
    as well is counted there for the other ball, and here for the visitor only.
    """
    cosine = units(asked.rows) @ units(held.rows).T
    limit = np.arccos(least)
    spread = asked.radii[:, None] + held.radii[None, :]
    angle = np.arccos(np.clip(cosine, -1, 1))
    exact = spread == 0
    all_ = np.where(exact, linked(asked.rows, held.rows, least), angle + spread <= limit - SLACK)
    some = ~exact & ~all_ & (angle - spread <= limit + SLACK)
    other = asked.keys[:, None] != held.keys[None, :]
    all_ &= other
    some &= other
    i, j = np.nonzero(all_)
    homes, home_of = np.unique(asked.homes, return_inverse=True)
    comes = np.stack([(held.ways == home).any(axis=1) for home in homes])  # which of the held visit each home
    returned = comes[home_of[i], j]
    gained = np.bincount(i, weights=held.sizes[j], minlength=len(asked.keys)).astype(np.int64)
    back = np.bincount(j[~returned], weights=asked.sizes[i[~returned]], minlength=len(held.keys)).astype(np.int64)
    counts = np.concatenate([
        np.stack([asked.keys[gained > 0], gained[gained > 0]], axis=1), np.stack([held.keys[back > 0], back[back > 0]], axis=1)
    ])
    keys = np.unique(np.concatenate([asked.keys, held.keys]))
    root = forest(len(keys), np.searchsorted(keys, asked.keys[i]), np.searchsorted(keys, held.keys[j]))
    tied = np.flatnonzero(root != np.arange(len(keys)))
    links = np.stack([keys[root[tied]], keys[tied]], axis=1)
    i, j = np.nonzero(some)
    near = np.stack([np.minimum(asked.keys[i], held.keys[j]), np.maximum(asked.keys[i], held.keys[j])], axis=1)
    return counts, links, near[:, 0], near[:, 1]


def _meet(balls: DataFrame, grid: Grid, visits: int, least: float) -> DataFrame:
    """What meetings give, as rows ``kind, a, b``: 0 links of a ball, 1 balls that hang together, 2 pairs to compare."""
    fields = "cell int, key bigint, size int, radius double, leader binary, home int, ways binary"
    schema, arrow = typed(fields)

    def travel(batches, away):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                leaders = part.column(4).to_pylist()
                home = part.column(1).to_numpy()
                ways = grid.traversals(units(np.stack([np.frombuffer(v, np.float64) for v in leaders])), visits)
                blobs = [w.tobytes() for w in ways]
                if away:
                    of = pa.array(np.repeat(np.arange(len(ways)), ways.shape[1]))
                    cell = pa.array(ways.ravel())
                else:
                    of, cell = pa.array(np.arange(len(ways))), pa.array(home)
                columns = [cell, *(part.column(k).take(of) for k in (0, 2, 3, 4, 1)), pa.array(blobs, pa.binary()).take(of)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    leaders = balls.select("key", "cell", "size", "radius", "leader")
    out, out_arrow = typed("kind int, a bigint, b bigint")

    def run(batches):
        for batch in batches:
            for row in _each(batch):
                counts, links, low, high = compare_packs(_Pack.of(*row[:7]), _Pack.of(*row[7:]), least)
                kind = np.repeat([0, 1, 2], [len(counts), len(links), len(low)]).astype(np.int32)
                a = np.concatenate([counts[:, 0], links[:, 0], low])
                b = np.concatenate([counts[:, 1], links[:, 1], high])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out_arrow)

    held = stored(_packs(leaders.mapInArrow(lambda b: travel(b, False), schema), HELD_ROWS, 1))
    asked = stored(_packs(leaders.mapInArrow(lambda b: travel(b, True), schema), QUERY_ROWS, 2))
    columns = ["n", "keys", "sizes", "radii", "vecs", "homes", "ways"]
    here = held.select("cell", *(F.col(c).alias(f"{c}_2") for c in columns))
    met = asked.join(here, "cell").select(*columns, *(f"{c}_2" for c in columns))
    return stored(met.mapInArrow(run, out))


def _by_members(balls: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Pairs of balls whose radii don't decide, member by member: ``kind, a, place, n``, 0 for links of one member, 1 for
    balls ``a`` and ``n`` that hang together."""
    side = lambda n: balls.select(
        F.col("key").alias(n), F.col("size").alias(f"size_{n}"),
        F.when(F.length("members") > 0, F.col("members")).otherwise(F.col("leader")).alias(f"vecs_{n}"),
    )
    schema, arrow = typed("kind int, a bigint, place int, n bigint")

    def run(batches):
        for batch in batches:
            for a, b, size_a, vecs_a, size_b, vecs_b, width in _each(batch):
                rows_a, rows_b = (np.frombuffer(v, np.float64).reshape(-1, width) for v in (vecs_a, vecs_b))
                found = linked(rows_a, rows_b, least)
                out = []
                # a ball of equal vectors comes as one row that stands for all
                for key, size, gains in ((a, size_a, found * 1 if len(rows_b) == size_b else found * size_b), (b, size_b, found.T * (1 if len(rows_a) == size_a else size_a))):
                    total = gains.sum(axis=1)
                    if len(total) != size:
                        total = np.repeat(total, size)
                    out += [(0, key, p, int(total[p])) for p in np.flatnonzero(total).tolist()]
                if found.any():
                    out.append((1, a, 0, b))
                columns = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    width = balls.select((F.length("leader") / 8).cast("int").alias("w")).first()
    return both.select("a", "b", "size_a", "vecs_a", "size_b", "vecs_b", F.lit(width["w"] if width else 0).alias("w")).mapInArrow(run, schema)


def visits_needed(balls: DataFrame, grid: Grid, count: int, least: float, recall: float = RECALL) -> int:
    """Cells to visit so that ``recall`` of links are found, measured on about ``CALIBRATION`` leaders.

    Their true links among all leaders are found exactly, and tell how many visits either side needs. As a table may
    have few links, and close ones only, each leader also gets made-up partners exactly at the threshold, which are the
    hardest to find; both kinds must reach ``recall``.
    """
    share = min(1.0, CALIBRATION / max(1, count))
    picked = balls.filter(F.pmod(F.xxhash64(F.lit("try"), "key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key", "cell", "leader").toArrow()
    if not picked.num_rows:
        picked = balls.select("key", "cell", "leader").limit(CALIBRATION).toArrow()
    if not picked.num_rows:
        return 1
    tried = np.stack([np.frombuffer(v, np.float64) for v in picked.column(2).to_pylist()])
    keys, homes = picked.column(0).to_numpy(), picked.column(1).to_numpy()
    order = grid.traversals(units(tried), grid.cells)
    rank = np.empty_like(order)  # the turn at which a leader comes to each cell
    np.put_along_axis(rank, order, np.arange(grid.cells, dtype=np.int32)[None], axis=1)

    def true_links(batches):
        for batch in batches:
            own = np.stack([np.frombuffer(v, np.float64) for v in batch.column(2).to_pylist()]) if batch.num_rows else np.zeros((0, tried.shape[1]))
            i, j = np.nonzero((units(tried) @ units(own).T >= least) & (keys[:, None] != batch.column(0).to_numpy()[None]))
            there = rank[i, batch.column(1).to_numpy()[j]]
            far = np.flatnonzero(there)  # those in one cell find each other at once
            to, who = np.unique(j[far], return_inverse=True)
            back = np.empty((len(to), grid.cells), np.int32)
            np.put_along_axis(back, grid.traversals(units(own[to]), grid.cells), np.arange(grid.cells, dtype=np.int32)[None], axis=1)
            there[far] = np.minimum(there[far], back[who, homes[i[far]]])
            turn, n = np.unique(there, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int32()), pa.array(n, pa.int64())], names=["turn", "n"])

    found = balls.select("key", "cell", "leader").mapInArrow(true_links, "turn int, n bigint").groupBy("turn").agg(F.sum("n").alias("n")).collect()
    turns = np.repeat([r["turn"] for r in found], [min(r["n"], 1 << 16) for r in found]) if found else np.zeros(0, int)
    made = []
    rng = np.random.default_rng(9)
    unit = units(tried)
    for _ in range(4):
        away = rng.normal(size=unit.shape)
        away -= (away * unit).sum(axis=1, keepdims=True) * unit
        partner = least * unit + np.sqrt(1 - least * least) * units(away)
        path = grid.traversals(partner, grid.cells)
        back = np.empty_like(path)
        np.put_along_axis(back, path, np.arange(grid.cells, dtype=np.int32)[None], axis=1)
        lines = np.arange(len(unit))
        made.append(np.minimum(rank[lines, path[:, 0]], back[lines, homes]))
    quantile = lambda x: int(np.sort(x)[min(len(x) - 1, int(np.ceil(recall * len(x))))]) + 1 if len(x) else 1
    return max(quantile(turns), quantile(np.concatenate(made)))


def _of_one_dimension(rows: DataFrame, least: float, ball: float) -> DataFrame:
    count = rows.count()
    place = F.pmod(F.xxhash64(F.lit("grid"), "vec_id", "embedding"), F.lit(1 << 30))
    share = min(1.0, SAMPLE_ROWS / max(1, count))
    sample = rows.filter(place < int(share * (1 << 30))).select("embedding").toArrow()
    if not sample.num_rows:
        sample = rows.select("embedding").limit(SAMPLE_ROWS).toArrow()
    grid = fit_grid(units(matrix(sample.column(0).combine_chunks())), count)

    def assign(batches):
        for batch in batches:
            cell = grid.traversals(units(matrix(batch.column(1))), 1)[:, 0] if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["vec_id", "embedding", "cell"])

    cells = blocks(rows.mapInArrow(assign, "vec_id bigint, embedding array<double>, cell int"), BLOCK_ROWS, ["cell"])
    balls = _balls(cells, ball)
    met = _meet(balls, grid, visits_needed(balls, grid, count, least), least)
    close = met.filter("kind = 2").select("a", "b").distinct()
    inside = stored(_by_members(balls, stored(close), least))
    links = met.filter("kind = 1").select("a", "b").unionByName(inside.filter("kind = 1").select("a", F.col("n").alias("b")))
    member = components(links).withColumnRenamed("node", "key")
    gained = met.filter("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("gained"))
    by_place = inside.filter("kind = 0").groupBy(F.col("a").alias("key"), "place").agg(F.sum("n").alias("n"))
    places = by_place.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("places"))
    named = stored(balls.select("key", "size", "first", "ids").join(member, "key", "left").withColumn("component", F.coalesce("component", "key")))
    ids = stored(named.groupBy("component").agg(F.min("first").alias("component_id")))
    whole = named.join(ids, "component").join(gained, "key", "left").join(places, "key", "left")
    schema, arrow = typed("vec_id bigint, n_links bigint, component_id bigint")

    def unfold(batches):
        for batch in batches:
            for n, component, more, special, blob in _each(batch):
                own = np.frombuffer(blob, np.int64)
                links = np.full(n, n - 1 + (more or 0), np.int64)
                for p, extra in special or ():
                    links[p] += extra
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(links), pa.array(np.full(n, component, np.int64))], schema=arrow)

    return whole.select("size", "component_id", "gained", "places", "ids").mapInArrow(unfold, schema)


def near_duplicate_vectors(vectors: DataFrame, least: float = LEAST, ball: float = BALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding``; others are ignored).

    ``n_links`` counts the other rows whose vector has a cosine of ``least`` or more, ``component_id`` is the least vec_id
    that can be reached over such links, itself included, and the row of that vec_id is ``kept``. Vectors that are null,
    zero or hold null or non-finite components, and rows without a vec_id, have no links; their component is their own
    vec_id, and those without one are not kept. Vectors link with those of their own dimension only. Repeated rows are
    vectors of their own and link with each other. An empty table gives none.

    The grid is fitted on about ``SAMPLE_ROWS`` rows, and all rows are put into it. ``ball`` must leave room for two
    members of one ball to be linked: twice its angle is less than the angle of ``least``.
    """
    if 2 * np.arccos(ball) + 1e-3 >= np.arccos(least):
        raise ValueError("balls are too wide for this threshold")
    good = F.col("vec_id").isNotNull() & usable() & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = stored(
        vectors.filter(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    )
    dims = sorted(r["d"] for r in rows.select(F.size("embedding").alias("d")).distinct().collect())
    parts = [_of_one_dimension(rows.filter(F.size("embedding") == d), least, ball) for d in dims]
    alone = vectors.filter(~good).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"))
    parts.append(alone.withColumn("component_id", F.col("vec_id")))
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
