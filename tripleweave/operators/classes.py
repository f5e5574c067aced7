"""Subjects with equal rows, compared once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.operators.checkpoints import stored
from tripleweave.operators.skew import dealt_join


def value_classes(side1: DataFrame, side2: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both ``blocked_side`` tables with one row set per class of subjects that have equal rows, and ``(s, c)`` of either side.

    Subjects with the same values in the same blocks match the same partners with the same scores, so they are compared
    once, under the name ``c``, 128 bits of the sum of their rows' hashes. A subject that both sides have is a class of its
    own with the same name on both, so that ``c1 != c2`` leaves out exactly the pairs of a subject with itself. Extra columns
    of the sides (``new``) belong to the rows that must be equal.
    """
    both = side1.select("s").distinct().join(side2.select("s").distinct(), "s", "left_semi").withColumn("both", F.lit(True))
    both = stored(both)
    tables, members = [], []
    for n, side in ((1, side1), (2, side2)):
        row = [F.col(c) for c in side.columns if c != "s"]
        marked = [x for c in row for x in (c, c.isNull())]  # hashes pass over nulls
        sums = [F.sum(F.xxhash64(F.lit(seed), *marked).cast("decimal(20,0)")) for seed in (17, 71)]
        held = side.groupBy("s").agg(F.concat_ws(" ", F.lit(str(n)), *sums, F.count(F.lit(1))).alias("rows")).join(both, "s", "left")
        name = F.md5(F.when(F.col("both"), F.concat(F.lit("s "), "s")).otherwise(F.col("rows")).cast("binary"))
        members.append(stored(held.select("s", name.alias("c"))))
        first = stored(members[-1].groupBy("c").agg(F.min("s").alias("s")))
        tables.append(stored(side.join(first, "s").select(F.col("c").alias("s"), *row)))
    return *tables, *members


_MOST = 256  # subjects that one name lists
_ESCAPES = {"\x03": "\x03a", "\x01": "\x03b", "\x02": "\x03c"}  # \x01 parts the names in a list, \x02 is an unknown one


def named_classes(side1: DataFrame, side2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``value_classes`` whose names list their subjects, so that ``of_names`` needs no join; large classes make several.

    A name travels as its subjects would, so this is for steps that don't write pairs of classes out.
    """
    out = []
    side1, side2, *members = value_classes(side1, side2)
    for side, own in zip((side1, side2), members):
        known = own.groupBy("c").agg(F.max(F.col("s").isNotNull()).alias("known"), F.ceil(F.count(F.lit(1)) / _MOST).alias("parts"))
        part = F.pmod(F.xxhash64("s"), F.col("parts"))
        name = F.col("s")
        for plain, mark in _ESCAPES.items():
            name = F.replace(name, F.lit(plain), F.lit(mark))
        listed = own.join(known.filter("known"), "c").groupBy("c", part.alias("part")).agg(
            F.array_join(F.sort_array(F.collect_list(F.coalesce(name, F.lit("\x02")))), "\x01").alias("name")
        )
        row = [c for c in side.columns if c != "s"]
        out.append(stored(side.join(listed.select(F.col("c").alias("s"), "name"), "s").select(F.col("name").alias("s"), *row)))
    return tuple(out)


def of_names(pairs: DataFrame) -> DataFrame:
    """Pairs of the classes of ``named_classes`` written out as the pairs of their subjects."""
    for end in ("s1", "s2"):
        name = F.explode(F.split(end, "\x01"))
        pairs = pairs.select(*[name.alias(c) if c == end else c for c in pairs.columns])
        plain = F.when(F.col(end) != "\x02", F.col(end))
        for char, mark in reversed(_ESCAPES.items()):
            plain = F.replace(plain, F.lit(mark), F.lit(char))
        pairs = pairs.withColumn(end, plain)
    return pairs


def of_members(pairs: DataFrame, members1: DataFrame, members2: DataFrame) -> DataFrame:
    """Pairs of classes ``(s1, s2, ...)`` written out as the pairs of their subjects; large classes are dealt out."""
    kept = [c for c in pairs.columns if c not in ("s1", "s2")]
    named = stored(pairs.withColumnsRenamed({"s1": "c1", "s2": "c2"}))
    half = stored(dealt_join(named, members1.toDF("s1", "c1"), ["c1"]).drop("c1"))
    return dealt_join(half, members2.toDF("s2", "c2"), ["c2"]).select("s1", "s2", *kept)
