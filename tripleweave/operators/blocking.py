"""Blocking of subjects by matched predicates.

The reference shape of a block table has one row per pair of statements, so its size is the product of
both sides' statements per predicate pair. It is kept here in factored form: each side's statements with
their block (``blocked_side``), and subjects grouped by the set of blocks they occur in (``profiles``).
How many predicates two subjects share depends on their profiles only, so counts per pair of subjects are
counts per pair of profiles; there are few profiles even when there are many subjects.
``block_by_predicate`` writes the product out for callers who want the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.functions.terms import comparable_value, literal_or_ending
from tripleweave.operators.checkpoints import stored
from tripleweave.operators.classes import of_members, value_classes
from tripleweave.operators.skew import dealt_join


def with_block(pairs: DataFrame) -> DataFrame:
    """Predicate pairs with the block's name ``b``, a digest of 128 bits.

    Store the result before it meets triples: predicates are few and frequent, and with the size of the
    pairs known the join is a broadcast instead of a shuffle of all triples onto a few predicates.
    """
    if "b" in pairs.columns:
        return pairs
    name = F.md5(F.concat_ws("\x01", "predicate1", "predicate2").cast("binary"))
    return pairs.select("predicate1", "predicate2", name.alias("b")).distinct()


def blocked_side(triples: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """``(s, b, v, m)``: comparable values of one graph's subjects per block, ``m`` equal statements each."""
    blocks = with_block(pairs).select(F.col(f"predicate{n}").alias("p"), "b")
    return (
        triples.join(blocks, "p")
        .select("s", "b", comparable_value("o").alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy("s", "b", "v")
        .agg(F.count(F.lit(1)).alias("m"))
    )


def block_by_predicate(t1: DataFrame, t2: DataFrame, pairs: DataFrame, salt: int = 16) -> DataFrame:
    """The block table itself: ``(s1, literal1, s2, literal2, p1, p2)``, one row per pair of statements.

    The product of a frequent predicate is divided over ``salt`` tasks: side 1 is dealt out by row hash,
    side 2 is repeated for each part.
    """
    pairs = stored(pairs.select("predicate1", "predicate2").distinct())  # few rows, known to be so: broadcast
    v1, v2 = comparable_value("o").alias("literal1"), comparable_value("o").alias("literal2")
    left = (
        t1.select(F.col("s").alias("s1"), F.col("p").alias("p1"), v1, F.pmod(F.xxhash64("s", "o"), F.lit(salt)).alias("part"))
        .filter(F.col("literal1").isNotNull())
        .join(pairs.toDF("p1", "p2"), "p1")
    )
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))).alias("part")
    right = t2.select(F.col("s").alias("s2"), F.col("p").alias("p2"), v2).filter(F.col("literal2").isNotNull())
    return left.join(right.select("*", parts), ["p2", "part"]).select("s1", "literal1", "s2", "literal2", "p1", "p2")


def block_rows_of_pairs(side1: DataFrame, side2: DataFrame, found: DataFrame) -> DataFrame:
    """Block rows ``(s1, literal1, s2, literal2, b)`` of given subject pairs, from both factored tables."""
    left = side1.select(F.col("s").alias("s1"), "b", F.col("v").alias("literal1"), "m")
    right = side2.select(F.col("s").alias("s2"), "b", F.col("v").alias("literal2"), F.col("m").alias("m2"))
    rows = found.select("s1", "s2").distinct().join(left, "s1").join(right, ["s2", "b"])
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m") * F.col("m2")))
    return rows.select("s1", "literal1", "s2", "literal2", "b", copies.alias("copy")).drop("copy")


def partners_per_level(profiles1: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(s1, count, partners)``: how many subjects of graph 2 share ``count`` with each subject of graph 1."""
    per_profile = clusters.groupBy("profile1", "count").agg(F.sum("subjects2").alias("partners"))
    return profiles1.toDF("s1", "profile1").join(per_profile, "profile1").select("s1", "count", "partners")


def block_sizes(t1: DataFrame, t2: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows the block table has per predicate pair, from counts per side."""
    pairs = stored(with_block(pairs))
    sides = []
    for n, t in ((1, t1), (2, t2)):
        per_subject = blocked_side(t, pairs, n).groupBy("b", "s").agg(F.sum("m").alias("rows"))
        sides.append(
            per_subject.groupBy("b").agg(F.sum("rows").alias(f"rows{n}"), F.count(F.lit(1)).alias(f"subjects{n}"))
        )
    joined = pairs.join(sides[0], "b").join(sides[1], "b")
    return joined.select(
        "predicate1", "predicate2", "subjects1", "subjects2", (F.col("rows1") * F.col("rows2")).alias("blocked_rows")
    )


def profiles(blocked: DataFrame, rows: bool = False) -> DataFrame:
    """``(s, profile)``: the sorted blocks of each subject; with ``rows`` also its statements in each."""
    per_block = blocked.groupBy("s", "b").agg(F.sum("m").alias("rows"))
    entry = F.struct("b", "rows") if rows else F.struct("b", F.lit(1).cast("bigint").alias("rows"))
    return per_block.groupBy("s").agg(F.sort_array(F.collect_list(entry)).alias("profile"))


def profile_pairs(profiles1: DataFrame, profiles2: DataFrame) -> DataFrame:
    """One row per pair of profiles that share a block.

    ``(profile1, profile2, subjects1, subjects2, predicates, rows)``: every pair of subjects with these
    profiles shares ``predicates`` predicate pairs and, if the profiles count rows, has ``rows`` rows in
    the block table.
    """
    sides = []
    for n, table in ((1, profiles1), (2, profiles2)):
        counted = table.groupBy("profile").agg(F.count(F.lit(1)).alias(f"subjects{n}"))
        sides.append(
            counted.select(
                F.col("profile").alias(f"profile{n}"), f"subjects{n}", F.inline("profile").alias("b", f"rows{n}")
            )
        )
    return (
        sides[0]
        .join(sides[1], "b")
        .groupBy("profile1", "profile2", "subjects1", "subjects2")
        .agg(F.count(F.lit(1)).alias("predicates"), F.sum(F.col("rows1") * F.col("rows2")).alias("rows"))
    )


def common_predicate_clusters(blocked1: DataFrame, blocked2: DataFrame) -> DataFrame:
    """Clusters in factored form: pairs of profiles with the number of predicates they share."""
    pairs = profile_pairs(profiles(blocked1), profiles(blocked2))
    return pairs.withColumnRenamed("predicates", "count").drop("rows")


def common_value_clusters(blocked1: DataFrame, blocked2: DataFrame) -> DataFrame:
    """Pairs of row-counting profiles with the number of value pairs of each of their subject pairs."""
    pairs = profile_pairs(profiles(blocked1, rows=True), profiles(blocked2, rows=True))
    return pairs.withColumnRenamed("rows", "count").drop("predicates")


def expand_clusters(clusters: DataFrame, profiles1: DataFrame, profiles2: DataFrame) -> DataFrame:
    """Factored clusters written out as ``(s1, s2, count)``; the result is as large as the product."""
    left, right = profiles1.toDF("s1", "profile1"), profiles2.toDF("s2", "profile2")
    return clusters.join(left, "profile1").join(right, "profile2").select("s1", "s2", "count")


def cluster_level_stats(clusters: DataFrame) -> DataFrame:
    """Per number of shared predicates: subject pairs and value comparisons they ask for."""
    pairs = F.sum(F.col("subjects1") * F.col("subjects2"))
    return (
        clusters.groupBy("count")
        .agg(pairs.alias("pairs"))
        .select("count", "pairs", (F.col("count") * F.col("pairs")).alias("comparisons"))
        .orderBy(F.desc("count"))
    )


def cluster_levels(clusters: DataFrame) -> DataFrame:
    """The numbers of shared predicates that occur, largest first."""
    return clusters.select("count").distinct().orderBy(F.desc("count"))


# --- the same counts on a written-out block table ------------------------------------------------------


def common_predicate_counts(blocks: DataFrame) -> DataFrame:
    """``(s1, s2, count)`` of distinct predicate pairs per subject pair of a block table."""
    distinct = blocks.select("s1", "p1", "s2", "p2").dropDuplicates()
    return distinct.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("count"))


def common_value_counts(blocks: DataFrame) -> DataFrame:
    """``(s1, s2, count)`` of rows per subject pair of a block table, largest first."""
    counts = blocks.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "s1", "s2")


def cluster_by_subjects(clusters: DataFrame) -> DataFrame:
    """Rows of one subject pair side by side in sorted partitions."""
    return clusters.repartition("s1", "s2").sortWithinPartitions("s1", "s2")


# --- subjects that share predicate and value -----------------------------------------------------------


def _features(triples: DataFrame) -> DataFrame:
    """``(s, p, v, m)``: statements with the same predicate and value, counted."""
    rows = triples.select("s", "p", literal_or_ending("o").alias("v"))
    return rows.groupBy("s", "p", "v").agg(F.count(F.lit(1)).alias("m"))


def _same_feature() -> Column:
    return F.col("l.p").eqNullSafe(F.col("r.p")) & F.col("l.v").eqNullSafe(F.col("r.v"))


def _lookup_keys(common: DataFrame, min_shared: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys ``(s, k)`` of one graph: pairs of features and single features of the subjects that pairs are cheaper for,
    single features of the others.

    With features in one order for both graphs (rare first), the first ``c`` features a pair shares lie
    among the first ``features - min_shared + c`` of either subject. Looking a subject up by pairs takes as many keys as
    there are pairs of these; by single features, as many meetings as their frequencies ``f`` say. The smaller number
    decides.
    """
    sizes = common.groupBy("s").agg(F.count(F.lit(1)).alias("features")).filter(F.col("features") >= min_shared)
    order = Window.partitionBy("s").orderBy("f", "h")
    ranked = common.join(sizes, "s").withColumn("h", F.xxhash64("p", "v")).withColumn("place", F.row_number().over(order))
    first = stored(ranked.filter(F.col("place") <= F.col("features") - min_shared + 2).select("s", "features", "h", "f", "place"))
    last = F.col("features") - min_shared + 1
    costs = first.groupBy("s").agg(
        F.sum(F.when(F.col("place") <= last, F.col("f")).otherwise(0)).cast("double").alias("single"), F.count(F.lit(1)).cast("double").alias("n")
    )
    wide = stored(costs.select("s", (F.col("n") * (F.col("n") - 1) / 2 > F.col("single")).alias("wide")))
    few = first.join(wide.filter("not wide").select("s"), "s")
    listed = few.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("es"))
    hs = F.transform("es", lambda e: e["h"])
    pairs = F.flatten(F.transform(hs, lambda x, i: F.transform(
        F.slice(hs, i + 2, F.size(hs)), lambda y: F.struct(x.alias("x"), y.alias("y"))
    )))
    large = ranked.join(wide.filter("wide").select("s"), "s").select("s", F.col("h").alias("k"))
    return listed.select("s", F.explode(pairs).alias("k")), few.filter(F.col("place") <= last).select("s", F.col("h").alias("k")), large


def shared_value_counts(t1: DataFrame, t2: DataFrame, min_shared: int = 1) -> DataFrame:
    """``(s1, s2, count)``: statement pairs with the same predicate and the same value, largest first.

    ``min_shared`` keeps pairs with at least that many different shared (predicate, value) features. From
    two on, pairs are found by two rare features together; features half of a graph has are not joined on
    alone, and subjects with equal features are compared once. With the default of one, the result is every pair that shares anything, as large as that is.
    """
    left, right = (stored(_features(t)) for t in (t1, t2))
    if min_shared == 1:
        pairs = left.alias("l").join(right.alias("r"), _same_feature()).select(
            F.col("l.s").alias("s1"), F.col("r.s").alias("s2"), F.col("l.m").alias("m1"), F.col("r.m").alias("m2")
        )
    else:
        left, right, *members = value_classes(left, right)
        counts = [d.groupBy("p", "v").agg(F.count(F.lit(1)).alias("f")) for d in (left, right)]
        freq = stored(
            counts[0].alias("l").join(counts[1].alias("r"), _same_feature())
            .select("l.p", "l.v", (F.col("l.f") * F.col("r.f")).alias("f"))
        )
        sides = [
            _lookup_keys(d.alias("l").join(freq.alias("r"), _same_feature()).select("l.s", "l.p", "l.v", "r.f"), min_shared)
            for d in (left, right)
        ]
        found = None
        for i, j in ((0, 0), (1, 2), (2, 1), (2, 2)):
            met = dealt_join(stored(sides[0][i].withColumnRenamed("s", "s1")), stored(sides[1][j].withColumnRenamed("s", "s2")), ["k"])
            found = met.select("s1", "s2") if found is None else found.unionByName(met.select("s1", "s2"))
        theirs = found.distinct().join(right.select(F.col("s").alias("s2"), "p", "v", F.col("m").alias("m2")), "s2")
        mine = left.select(F.col("s").alias("s1"), "p", "v", F.col("m").alias("m1"))
        pairs = theirs.alias("l").join(mine.alias("r"), _same_feature() & (F.col("l.s1") == F.col("r.s1"))).select(
            "l.s1", "l.s2", "r.m1", "l.m2"
        )
    counted = pairs.groupBy("s1", "s2").agg(
        F.sum(F.col("m1") * F.col("m2")).alias("count"), F.count(F.lit(1)).alias("features")
    )
    kept = counted.filter(F.col("features") >= min_shared).select("s1", "s2", "count")
    if min_shared > 1:
        kept = of_members(kept, *members)
    return kept.orderBy(F.desc("count"), "s1", "s2")
