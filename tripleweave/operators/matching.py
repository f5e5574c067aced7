"""From similar values to matched subjects.

``match_leaves`` gives the matches of two graphs without writing the block table out:

1. values of each block are joined by similarity (:mod:`value_join`), once per distinct value;
2. subjects are grouped by the blocks they occur in, which gives the number of shared predicates ``n``
   and so the score a pair must reach, ``threshold(n) * n``;
3. a pair that reaches it has similar values in all but a few of its shared blocks, hence in all blocks of some small
   set. Per pair of profiles, sets of up to three of the rarest blocks are chosen by expected cost, so a value half of all
   subjects have is not looked up alone when anything rarer helps;
4. lots of subjects of either side meet in tasks, where candidates are found by those sets and scored in full. Only
   matches leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.config import LEVEL_DEFAULT, LEVEL_THRESHOLDS, LITERAL_THRESHOLD, PARENT_THRESHOLD, Thresholds
from tripleweave.functions import pairing, text
from tripleweave.operators.blocking import blocked_side, common_value_counts, with_block
from tripleweave.operators.checkpoints import spread, stored, tasks_for
from tripleweave.operators.classes import named_classes, of_names
from tripleweave.operators.encoding import dictionary
from tripleweave.operators.filters import above, non_reflexive, not_null_values
from tripleweave.operators.predicates import lexical_pairs
from tripleweave.operators.value_join import exact_pairs, literal_pairs, literal_scores, short_key

_KEY_SIZES = (1, 2, 3)  # blocks whose values are joined on together


def level_threshold(n: Column) -> Column:
    """Normalised score a pair with ``n`` shared predicates must exceed."""
    result = F.lit(LEVEL_DEFAULT)
    for level, value in LEVEL_THRESHOLDS.items():
        result = F.when(n == level, F.lit(value)).otherwise(result)
    return result


# --- operators on a written-out block table ------------------------------------------------------------


def score_blocked(
    blocks: DataFrame, mode: str = "string", threshold: float = LITERAL_THRESHOLD, sims: DataFrame | None = None
) -> DataFrame:
    """``(s1, s2, score)`` of block rows whose values are similar above the threshold.

    ``string``: words and edit distance; ``lexical``: words through ``sims``; ``exact``: identical values.
    Each distinct pair of values is scored once.
    """
    rows = not_null_values(blocks.select("s1", "literal1", "s2", "literal2"), "literal1", "literal2")
    if mode == "exact":
        return rows.filter(F.col("literal1") == F.col("literal2")).select("s1", "s2", F.lit(1.0).alias("score"))
    pairs = rows.select(F.col("literal1").alias("v1"), F.col("literal2").alias("v2")).distinct()
    if mode == "string":
        scored = literal_scores(pairs, threshold)
    elif mode == "lexical":
        scored = lexical_pairs(
            pairs.select(F.col("v1").alias("v")).distinct(), pairs.select(F.col("v2").alias("v")).distinct(),
            Thresholds.from_string(threshold).lexical, threshold, sims,
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    scored = above(scored, threshold).toDF("literal1", "literal2", "score")
    return rows.join(scored, ["literal1", "literal2"]).select("s1", "s2", "score")


def literals_of_cluster(blocks: DataFrame, clusters: DataFrame, level: int, matched: DataFrame | None = None) -> DataFrame:
    """Block rows of the subject pairs with ``level`` shared predicates that are not matched yet."""
    chosen = clusters.filter(F.col("count") == level).select("s1", "s2").distinct()
    if matched is not None:
        chosen = chosen.join(matched.select("s1", "s2"), ["s1", "s2"], "left_anti")
    return blocks.join(chosen, ["s1", "s2"]).select("s1", "literal1", "s2", "literal2")


def score_with_counts(matches: DataFrame, counts: DataFrame) -> DataFrame:
    """Summed scores per pair next to the pair's count."""
    sums = matches.groupBy("s1", "s2").agg(F.sum("score").alias("total"))
    return sums.join(counts.select("s1", "s2", "count"), ["s1", "s2"])


def aggregate_matches(matches: DataFrame, counts: DataFrame, threshold: float = LEVEL_DEFAULT) -> DataFrame:
    """Pairs whose summed score divided by their count exceeds the threshold."""
    scored = score_with_counts(matches, counts)
    return above(
        non_reflexive(scored.select("s1", "s2", (F.col("total") / F.col("count")).alias("score"))), threshold
    )


def aggregate_matches_level(matches: DataFrame, level: int) -> DataFrame:
    """``aggregate_matches`` for pairs known to share ``level`` predicates, at that level's threshold."""
    sums = matches.groupBy("s1", "s2").agg((F.sum("score") / F.lit(float(level))).alias("score"))
    return above(non_reflexive(sums), LEVEL_THRESHOLDS.get(level, LEVEL_DEFAULT))


def match_leaves_of_blocks(
    blocks: DataFrame,
    clusters: DataFrame,
    mode: str = "string",
    skip_lowest: bool = False,
    sims: DataFrame | None = None,
    min_shared: int = 1,
    exclusive: bool = False,
) -> DataFrame:
    """Matches ``(s1, s2, score)`` of a written-out block table and its clusters ``(s1, s2, count)``.

    Every pair lies on one level only, so all levels are scored in one pass with the threshold as a column. For the
    options see ``match_sides``.
    """
    clusters = chosen_levels(clusters, skip_lowest, min_shared)
    total = score_blocked(blocks, mode, sims=sims).groupBy("s1", "s2").agg(F.sum("score").alias("total"))
    scored = total.join(clusters.select("s1", "s2", "count"), ["s1", "s2"]).select(
        "s1", "s2", (F.col("total") / F.col("count")).alias("score"), "count"
    )
    found = non_reflexive(scored).filter(F.col("score") > level_threshold(F.col("count")))
    return (level_by_level(found) if exclusive else found).drop("count")


def chosen_levels(rows: DataFrame, skip_lowest: bool, min_shared: int) -> DataFrame:
    """Rows whose ``count`` takes part in matching: from ``min_shared`` on, and with ``skip_lowest`` not the smallest."""
    if skip_lowest:
        rows = without_lowest(rows, rows)
    return rows.filter(F.col("count") >= min_shared) if min_shared > 1 else rows


def level_by_level(found: DataFrame) -> DataFrame:
    """Of matches ``(s1, s2, score, count)`` those whose subjects are not matched on a higher level already.

    Levels go from many shared predicates to few; within a level every match stays. Each level's result is stored
    before the next one looks at it. There are no more levels than predicate pairs, and only their numbers come back.
    """
    found = stored(found)
    levels = sorted((r["count"] for r in found.select("count").distinct().collect()), reverse=True)
    kept = None
    for level in levels:
        here = found.filter(F.col("count") == level)
        if kept is not None:
            for end in ("s1", "s2"):
                here = here.join(kept.select(end).distinct(), end, "left_anti")
        here = stored(here.select(*found.columns))
        kept = here if kept is None else kept.unionByName(here)
    return found if kept is None else kept


def without_lowest(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Drops the smallest ``count``, unless it is the only one."""
    ends = levels.agg(F.min("count").alias("lo"), F.max("count").alias("hi"))
    low, high = ends.select("lo").scalar(), ends.select("hi").scalar()
    return rows.filter((F.col("count") > low) | (low == high))


def match_parents(blocks: DataFrame, earlier: DataFrame, mode: str = "any", sims: DataFrame | None = None) -> DataFrame:
    """Matches among neighbour blocks.

    ``any``: every pair with one pair of similar values, together with ``earlier`` value-level matches,
    one row per pair with its best score. ``normed``: the mean score of the pair's similar values must
    exceed the parent threshold.
    """
    rows = score_blocked(blocks, sims=sims)
    if mode == "normed":
        return aggregate_matches(rows, common_value_counts(rows), PARENT_THRESHOLD)
    pairs = non_reflexive(rows).unionByName(earlier.select("s1", "s2", "score"))
    return pairs.groupBy("s1", "s2").agg(F.max("score").alias("score"))


# --- matching without the block table ------------------------------------------------------------------


def similar_values(
    side1: DataFrame, side2: DataFrame, mode: str = "string", threshold: float = LITERAL_THRESHOLD,
    sims: DataFrame | None = None, as_keys: bool = False,
) -> DataFrame:
    """``(b, v1, v2, score)`` of the similar values of each block of two ``blocked_side`` tables."""
    values1, values2 = (d.select("b", "v").distinct() for d in (side1, side2))
    if mode == "exact":
        return exact_pairs(*(keyed(d) if as_keys else d for d in (values1, values2)), ["b"])
    if mode == "lexical":
        word = Thresholds.from_string(threshold).lexical
        return lexical_pairs(values1, values2, word, threshold, sims, keys=["b"], as_keys=as_keys)
    return literal_pairs(values1, values2, threshold, ["b"], as_keys)


def keyed(table: DataFrame) -> DataFrame:
    """A table of values ``v`` with long texts replaced by their join keys."""
    return table.withColumn("v", short_key("v"))


def partner_values(side1: DataFrame, similar: DataFrame) -> DataFrame:
    """``(s1, b, v, w)``: values of graph 2 that resemble a value of ``s1``, ``w`` the summed score."""
    joined = side1.select(F.col("s").alias("s1"), "b", F.col("v").alias("v1"), "m").join(similar, ["b", "v1"])
    return joined.groupBy("s1", "b", F.col("v2").alias("v")).agg(
        F.sum(F.col("m") * F.col("score")).alias("w"), F.max("score").alias("top")
    )


def _kind(most: Column) -> Column:
    """Bound on a subject's weight in a block, in powers of two so that there are few profiles.

    On side 2 it is the number of statements, on side 1 the greatest weight of a partner value (which scores above 1 and
    repeated statements raise, to infinity if need be); a pair's score in a block is at most the product of both.
    """
    most = F.greatest(F.lit(1.0), F.coalesce(most, F.lit(1.0)))
    step = F.pow(F.lit(2.0), F.ceil(F.log2(F.when(most < float("inf"), most)) - 1e-9))
    return F.coalesce(step, F.lit(float("inf")))


def _profile_name() -> Column:
    """A digest that stands for a ``profile``, blocks with their kinds, in joins."""
    named = F.transform("profile", lambda e: F.concat_ws("=", e["b"].cast("string"), e["kind"].cast("string")))
    return F.md5(F.array_join(named, " ").cast("binary"))


def _shares(subjects1: DataFrame, subjects2: DataFrame, met: DataFrame) -> DataFrame:
    """``(b, spread, density)``: mean partner values per subject of side 1, and the share of pairs with similar values.

    ``subjects`` count those of each block (``n1``, ``n2``), ``met (b, c1, c2)`` a value's rows on either side.
    """
    met = met.groupBy("b").agg(F.sum("c1").alias("rows"), F.sum(F.col("c1").cast("double") * F.col("c2")).alias("pairs"))
    return subjects1.join(subjects2, "b").join(met, "b", "left").select(
        "b",
        F.coalesce(F.col("rows") / F.col("n1"), F.lit(0.0)).alias("spread"),
        F.coalesce(F.col("pairs") / F.col("n1") / F.col("n2"), F.lit(0.0)).alias("density"),
    )


def _ways_to_choose(numbers: Column, size: int) -> Column:
    """Sum of the products of all ``size`` of the numbers."""
    start = F.struct(*[F.lit(1.0 if k == 0 else 0.0).alias(f"e{k}") for k in range(size + 1)])
    step = lambda acc, x: F.struct(
        acc["e0"].alias("e0"), *[(acc[f"e{k}"] + acc[f"e{k - 1}"] * x).alias(f"e{k}") for k in range(1, size + 1)]
    )
    return F.aggregate(numbers, start, step, lambda acc: acc[f"e{size}"])


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x)


def _long_enough(size: int) -> Callable[[Column], Column]:
    """Whether a head of ``m`` blocks holds ``size`` similar ones of every pair that scores more than ``need``."""

    def test(m: Column) -> Column:
        weights = F.transform(F.slice("entries", F.lit(1), m), lambda e: e["weight"])
        tail = F.transform(F.slice("entries", m + 1, F.size("entries")), lambda e: e["weight"])
        heaviest = _total(F.slice(F.sort_array(weights, asc=False), 1, size - 1)) if size > 1 else F.lit(0.0)
        return _total(tail) + heaviest <= F.col("need")

    return test


def key_plan(pairs: DataFrame) -> DataFrame:
    """``(g1, g2, count, size, head)``: a pair of subjects that scores enough is similar in ``size`` blocks of ``head``.

    ``pairs`` has ``g1, g2, n1, n2, count, threshold`` and ``entries (density, b, weight, spread)``, all blocks that
    subjects of both profiles have. Blocks are ordered from rare to frequent matches. With the frequent tail left out, a
    pair still needs ``size`` similar blocks among the first as long as the tail and the ``size - 1`` heaviest of the first
    cannot reach the threshold; the shortest such head is taken. Subjects are then joined on the values of any ``size``
    blocks of the head together. The size with the least rows to join wins: keys of either side, and expected meetings.
    """
    ordered = pairs.withColumn("entries", F.sort_array("entries")).withColumn("need", F.col("threshold") * F.col("count"))
    options = []
    for size in _KEY_SIZES:
        lengths = F.when(F.size("entries") >= size, F.sequence(F.lit(size), F.size("entries")))
        m = F.get(F.filter(lengths, _long_enough(size)), F.lit(0))
        ordered = ordered.withColumn(f"m{size}", m)
        first = F.slice("entries", F.lit(1), F.col(f"m{size}"))
        spread = F.transform(first, lambda e: F.greatest(e["spread"], F.lit(1.0)))
        density = F.transform(first, lambda e: e["density"])
        ones = F.transform(first, lambda e: F.lit(1.0))
        cost = (
            F.col("n1") * _ways_to_choose(spread, size) + F.col("n2") * _ways_to_choose(ones, size)
            + F.col("n1").cast("double") * F.col("n2") * _ways_to_choose(density, size)
        )
        blocks = F.transform(first, lambda e: e["b"])
        options.append(F.when(F.col(f"m{size}").isNotNull(), F.struct(cost.alias("cost"), F.lit(size).alias("size"), blocks.alias("head"))))
    best = F.array_min(F.filter(F.array(*options), lambda o: o.isNotNull()))
    return ordered.select("g1", "g2", "count", best.alias("best")).select("g1", "g2", "count", "best.size", "best.head")


def profile_entries(profiles1: DataFrame, profiles2: DataFrame, density: DataFrame) -> DataFrame:
    """Pairs of profiles that share a block, as ``key_plan`` wants them but for the threshold."""
    sides = []
    for n, table in ((1, profiles1), (2, profiles2)):
        counted = table.groupBy("g", "profile").agg(F.count(F.lit(1)).alias(f"n{n}"))
        sides.append(
            counted.select(F.col("g").alias(f"g{n}"), f"n{n}", F.inline("profile").alias("b", f"kind{n}"))
        )
    entry = F.struct("density", "b", (F.col("kind1") * F.col("kind2")).alias("weight"), "spread")
    return (
        sides[0].join(sides[1], "b").join(density, "b")
        .groupBy("g1", "g2", "n1", "n2")
        .agg(F.count(F.lit(1)).alias("count"), F.collect_list(entry).alias("entries"))
    )


def _sets(size: int) -> Column:
    """All ``size`` of the blocks of ``head``, in its order."""

    def after(prefix: list[Column], low: Column, left: int) -> Column:
        if not left:
            return F.array(F.array(*prefix))
        last = F.size("head") - left
        return F.flatten(F.transform(
            F.when(last >= low, F.sequence(low, last)).otherwise(F.array().cast("array<int>")),
            lambda i: after([*prefix, F.get("head", i)], i + 1, left - 1),
        ))

    return after([], F.lit(0), size)


def match_leaves(
    t1: DataFrame, t2: DataFrame, pairs: DataFrame, mode: str = "string", skip_lowest: bool = False,
    sims: DataFrame | None = None, min_shared: int = 1, exclusive: bool = False,
) -> DataFrame:
    """Matches ``(s1, s2, score)`` of two graphs' literal statements under matched predicates.

    The result is that of ``match_leaves_of_blocks`` on the full block table. For the options see ``match_sides``.
    """
    pairs = stored(with_block(pairs))
    side1, side2 = stored(blocked_side(t1, pairs, 1)), stored(blocked_side(t2, pairs, 2))
    return match_sides(side1, side2, mode, skip_lowest, sims, min_shared, exclusive)


def match_sides(
    side1: DataFrame, side2: DataFrame, mode: str = "string", skip_lowest: bool = False, sims: DataFrame | None = None,
    min_shared: int = 1, exclusive: bool = False,
) -> DataFrame:
    """``match_leaves`` on the two factored block tables.

    All pairs of subjects that share a predicate are compared. ``min_shared`` asks for more shared predicates;
    ``skip_lowest`` leaves out the pairs with the fewest there are, unless all have that many, so that what is kept
    depends on the rest of the graph; ``exclusive`` keeps a match only if neither subject is matched with more shared
    predicates. Subjects with equal values are matched as one (``named_classes``); their pairs are written out at the end.
    """
    return of_names(match_classes(*named_classes(side1, side2), mode, skip_lowest, sims, min_shared, exclusive))


def match_classes(
    side1: DataFrame, side2: DataFrame, mode: str = "string", skip_lowest: bool = False, sims: DataFrame | None = None,
    min_shared: int = 1, exclusive: bool = False,
) -> DataFrame:
    """``match_sides`` of sides with one row set per class of subjects: matches of classes, not written out.

    Either side is stored once as lots of subjects with their values. Every lot of one side meets every lot of the other in
    a task, which finds and scores their pairs (``pairing.lot_matches``); pairs are neither shuffled nor stored.
    """
    similar = similar_values(side1, side2, mode, sims=sims, as_keys=True)
    side1, side2 = keyed(side1), keyed(side2)
    ids, similar = _numbered_values(similar)
    subjects1 = stored(_subjects(side1.join(similar, ["b", "v"], "left"), F.sum(F.col("m") * F.col("score")), F.max("w")))
    subjects2 = stored(_subjects(side2.join(ids, ["b", "v"], "left"), F.sum("m").cast("double"), F.sum("w")))
    density = _density(subjects1, subjects2, ids)
    shared = chosen_levels(stored(profile_entries(subjects1, subjects2, density)), skip_lowest, min_shared)
    heads = F.transform("head", lambda b: F.xxhash64(b)).alias("head")
    plan = key_plan(shared.withColumn("threshold", level_threshold(F.col("count")))).filter("size is not null")
    plan = stored(plan.select("g1", "g2", "count", "size", heads, level_threshold(F.col("count")).alias("threshold")))
    if not exclusive:
        return _pairs_of(_cells(subjects1, subjects2, plan))

    # Level by level, from many shared predicates to few: what is matched takes no part in the next ones
    levels = sorted((r["count"] for r in plan.select("count").distinct().collect()), reverse=True)
    found = None
    for level in levels:
        cells = _cells(subjects1, subjects2, plan.filter(F.col("count") == level))
        here = _pairs_of(cells)
        found = here if found is None else found.unionByName(here)
        if level != levels[-1]:
            ends = stored(_ends_of(cells).distinct())
            subjects1, subjects2 = (
                stored(d.join(ends.filter(F.col("side") == n).select("s"), "s", "left_anti").select(*d.columns)) for n, d in ((1, subjects1), (2, subjects2))
            )
    return _pairs_of(_cells(subjects1, subjects2, plan)) if found is None else found


def _numbered_values(similar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids ``(b, v, id)`` of the values of graph 2 that resemble one of graph 1, and ``similar`` with them: ``(b, v, id, score)``."""
    similar = stored(similar.select("b", "v1", "v2", "score"))
    both = F.concat("b", F.lit(" "), "v2")
    ids = stored(dictionary(similar.select(both.alias("term"))))
    named = similar.select("b", F.col("v2").alias("v"), both.alias("term")).distinct().join(ids, "term")
    ids = stored(named.select("b", "v", "id"))
    rows = similar.select("b", F.col("v1").alias("v"), F.col("v2"), "score").join(ids.withColumnRenamed("v", "v2"), ["b", "v2"])
    return ids, stored(rows.select("b", "v", "id", "score"))


def _subjects(rows: DataFrame, weight: Column, most: Column) -> DataFrame:
    """``(s, profile, g, e)`` of rows ``(s, b, id, m)``: a subject's blocks with their kinds, see ``_kind``, their digest, and its
    entries ``(id, block, weight)`` with values that resemble another graph's. All is done where the subject's rows come together."""
    weighed = spread(rows, "s").groupBy("s", "b", "id").agg(weight.alias("w"))
    entry = F.when(F.col("id").isNotNull(), F.struct("id", F.xxhash64("b").alias("block"), "w"))
    blocks = weighed.groupBy("s", "b").agg(_kind(most).alias("kind"), F.collect_list(entry).alias("es"))
    table = blocks.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("b", "kind"))).alias("profile"), F.flatten(F.collect_list("es")).alias("e"))
    return table.select("s", "profile", _profile_name().alias("g"), "e")


def _density(subjects1: DataFrame, subjects2: DataFrame, ids: DataFrame) -> DataFrame:
    """``_shares`` of the tables that ``_subjects`` gives."""
    held = [d.select(F.explode("profile.b").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias(f"n{n}")) for n, d in ((1, subjects1), (2, subjects2))]
    met = [d.select(F.explode("e.id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias(f"c{n}")) for n, d in ((1, subjects1), (2, subjects2))]
    return _shares(*held, met[0].join(met[1], "id").join(ids, "id"))


_LOT_ROWS, _LOT_ENTRIES, _LOT_BYTES = 50_000, 500_000, 8 << 20  # most that a lot of subjects holds, about


def _lots(subjects: DataFrame) -> tuple[DataFrame, int]:
    """``(lot, s, g, e)`` and the number of lots: subjects with entries, those of one profile side by side."""
    rows = subjects.filter(F.size("e") > 0).select("s", "g", "e")
    n, entries, length = rows.agg(F.count(F.lit(1)), F.sum(F.size("e")), F.sum(F.length("s"))).first()
    tasks = tasks_for(subjects.sparkSession)
    lots = max(1, -(-n // _LOT_ROWS), -(-(entries or 0) // _LOT_ENTRIES), -(-(length or 0) // _LOT_BYTES), min(math.isqrt(tasks) + 1, n // 1000))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(stored(sizes.select("g", "n", before.alias("before"))), "g")
    lot = F.floor((F.col("before") + F.pmod(F.xxhash64("s"), F.col("n"))) * lots / max(1, n)).cast("int")
    return placed.select(lot.alias("lot"), "s", "g", "e"), lots


def _cells(subjects1: DataFrame, subjects2: DataFrame, plan: DataFrame) -> DataFrame:
    """``(rows1, plan, rows2)``: every lot of one side with every lot of the other, as a product that shuffles neither."""
    (rows1, lots1), (rows2, lots2) = _lots(subjects1), _lots(subjects2)
    rows1 = stored(rows1)
    plans = stored(rows1.select("lot", F.col("g").alias("g1")).distinct().join(plan, "g1"))

    def pack1(key: tuple, rows: pa.Table, plans: pa.Table) -> pa.Table:
        return pa.table({"rows1": [pairing.packed(rows.drop_columns(["lot"]))], "plan": [pairing.packed(plans.drop_columns(["lot"]))]})

    def pack2(rows: pa.Table) -> pa.Table:
        return pa.table({"rows2": [pairing.packed(rows.drop_columns(["lot"]))]})

    packs1 = stored(rows1.groupBy("lot").cogroup(plans.groupBy("lot")).applyInArrow(pack1, "rows1 binary, plan binary"))
    packs2 = stored(rows2.groupBy("lot").applyInArrow(pack2, "rows2 binary"))
    return packs1.repartition(lots1).crossJoin(packs2.repartition(lots2).hint("shuffle_replicate_nl"))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(batch.num_rows):  # a row holds two lots
            rows1, plan, rows2 = (pairing.unpacked(c[at].as_py()) for c in batch.columns)
            yield from pairing.lot_matches(rows1, rows2, plan.to_pylist())


def _pairs_of(cells: DataFrame) -> DataFrame:
    """``(s1, s2, score)``: the matches in the cells, but for subjects with themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, i, j, score, _ in _found(batches):
            for low in range(0, len(i), _BATCH):
                part = slice(low, low + _BATCH)
                s1, s2 = (lot.table["s"].combine_chunks().take(pa.array(k[part])) for lot, k in ((one, i), (two, j)))
                rows = pa.RecordBatch.from_arrays([s1, s2, pa.array(score[part])], names=["s1", "s2", "score"])
                yield rows.filter(pc.not_equal(s1, s2))

    return cells.mapInArrow(run, "s1 string, s2 string, score double")


_BATCH = 10_000


def _ends_of(cells: DataFrame) -> DataFrame:
    """``(side, s)`` of all subjects that match one in a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, i, j, _, _ in _found(batches):
            s1, s2 = one.table["s"].combine_chunks(), two.table["s"].combine_chunks()
            other = pc.not_equal(s1.take(pa.array(i)), s2.take(pa.array(j))).to_numpy(zero_copy_only=False)
            for side, names, k in ((1, s1, i[other]), (2, s2, j[other])):
                names = names.take(pa.array(np.unique(k)))
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(names), pa.int32()), names], names=["side", "s"])

    return cells.mapInArrow(run, "side int, s string")
