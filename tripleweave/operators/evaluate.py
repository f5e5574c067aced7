"""Evaluation of found matches against a gold alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.functions.text import compression_ratio


def both_directions(found: DataFrame) -> DataFrame:
    """Found pairs and the same pairs swapped."""
    pairs = found.select("s1", "s2").distinct()
    return pairs.unionByName(pairs.select(F.col("s2").alias("s1"), F.col("s1").alias("s2")))


def missed_pairs(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Gold pairs not found in either direction."""
    return gold.select("s1", "s2").subtract(both_directions(found))


def extra_pairs(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Found pairs, in both directions, that are not in the gold alignment."""
    return both_directions(found).subtract(gold.select("s1", "s2"))


def evaluate_alignment(gold: DataFrame, found: DataFrame, part: str | None = None) -> DataFrame:
    """One row: gold and found pairs, misses, extras, precision, recall, F1.

    With ``part``, also ``part_extras``: extras whose both ends contain the text, and ``other_found``:
    distinct directed pairs whose ends do not both contain it. All counts come from one grouping of a pair's both directions
    by 128 bits that stand for its ends, so that each pair of ``found`` is read once and travels once, without names.
    """
    unknown = F.col("s1").isNull() | F.col("s2").isNull()  # equals nothing, so it is a row of its own
    known1, known2 = F.col("s1").isNotNull(), F.col("s2").isNotNull()
    swapped = F.coalesce(F.col("s1") > F.col("s2"), known1 & ~known2)
    inside = F.lit(False) if part is None else F.coalesce(F.col("s1").contains(part) & F.col("s2").contains(part), F.lit(False))
    outside = F.lit(False) if part is None else F.coalesce(~(F.col("s1").contains(part) & F.col("s2").contains(part)), F.lit(False))

    def marked(pairs: DataFrame, gold: bool) -> DataFrame:
        ends = [F.when(swapped, F.col(b)).otherwise(F.col(a)) for a, b in (("s1", "s2"), ("s2", "s1"))]
        nulls = [e.isNull() for e in ends]
        name = F.unhex(F.md5(F.to_json(F.struct(*[F.coalesce(e, F.lit("")).alias(f"e{n}") for n, e in enumerate(ends)], *[x.alias(f"n{n}") for n, x in enumerate(nulls)], F.when(unknown, gold).alias("apart"))).cast("binary")))
        bit = lambda there, n: F.when(there, 1 << n).otherwise(0)
        first, second = (0, 1) if gold else (2, 3)
        twins = F.coalesce(F.col("s1") == F.col("s2"), ~known1 & ~known2)  # the same in both directions
        flags = bit(~swapped, first) + bit(swapped, second) + bit(twins, 4) + bit(inside, 5) + bit(outside, 6) + bit(unknown, 7)
        return pairs.select(name.alias("name"), flags.cast("smallint").alias("flags"))

    rows = marked(gold, True).unionByName(marked(found, False)).groupBy("name").agg(F.bit_or("flags").alias("flags"))
    has = lambda n: F.col("flags").bitwiseAND(1 << n) != 0
    any_found, ways = has(2) | has(3), F.when(has(4), F.lit(1)).otherwise(2)

    def n(there) -> Column:
        return F.coalesce(F.sum(there), F.lit(0)).cast("bigint")

    gold_ways = has(0).cast("int") + has(1).cast("int")
    extra = F.when(any_found, ways - gold_ways).otherwise(0)
    columns = [
        n(gold_ways).alias("gold_pairs"), n(F.when(~has(7), has(2).cast("int") + has(3).cast("int")).otherwise(0)).alias("found_pairs"),
        n(F.when(~any_found, gold_ways).otherwise(0)).alias("missed"), n(extra).alias("extra"), n(F.when(any_found, gold_ways).otherwise(0)).alias("hits"),
    ]
    if part is not None:
        columns += [n(F.when(has(5), extra).otherwise(0)).alias("part_extras"), n(F.when(any_found & has(6), ways).otherwise(0)).alias("other_found")]
    counts = rows.agg(*columns)
    precision = F.try_divide(F.col("hits").cast("double"), F.col("found_pairs"))
    recall = F.try_divide(F.col("hits").cast("double"), F.col("gold_pairs"))
    rated = counts.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.try_divide(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.withColumn("f1", f1)


def compression(n1: DataFrame, n2: DataFrame, kept: DataFrame) -> DataFrame:
    """Share of kept pairs in the sizes of both lists, in percent."""
    sizes = [d.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar() for d in (n1, n2)]
    return kept.agg(F.count(F.lit(1)).cast("double").alias("kept")).select(
        compression_ratio(sizes[0] + sizes[1], F.col("kept")).alias("compression")
    )
