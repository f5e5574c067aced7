"""Exact similarity joins of distinct values.

Two columns of values are compared without forming their product. Every join below is an equi-join on
something two similar values must share (the lower-case text, a word, a piece of the text) followed by
the exact measure, so the result is that of comparing all pairs. ``keys`` names columns both sides must
agree on (the matched predicate pair); values are distinct per key, so copies cost one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.functions import text
from tripleweave.functions.cells import cell_hits
from tripleweave.operators.checkpoints import spread, stored
from tripleweave.operators.encoding import dictionary

_EPS = 1e-9
_LONG = 80  # length from which a text is represented by its digest
_FEW_PAIRS = 100_000  # so few pairs of values are never worth cells
_SPARSE = 20  # cells are used where words make more than the pairs' number over this to look at
_CELL = 1000  # values of either side in a cell


def short_key(c: Column | str) -> Column:
    """Stands for a value in joins: short texts themselves, a digest for long ones, so that these travel once."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > _LONG, F.concat(F.lit("\x01"), F.sha2(c, 256))).otherwise(c)


def with_tokens(values: DataFrame, tokens: Callable[[str], Column] = text.value_tokens) -> DataFrame:
    """Adds the join key ``k`` of ``v``, its words, their number and whether nothing is left after cleaning."""
    return values.withColumn("tokens", tokens("v")).select(
        "*",
        short_key("v").alias("k"),
        F.size("tokens").alias("n"),
        ((F.size("tokens") == 1) & (F.get("tokens", F.lit(0)) == "")).alias("blank"),
    )


def side(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Marks all but the key columns with the side number."""
    return df.select(*keys, *[F.col(c).alias(f"{c}{n}") for c in df.columns if c not in keys])


def equal_pairs(left: DataFrame, right: DataFrame, keys: list[str], column: str = "v") -> DataFrame:
    """``(keys, v1, v2)`` with equal non-empty text, case aside; ``column`` of both sides is returned."""
    on = [*keys, "low"]
    low = [
        d.filter(d.v != "").select(*keys, F.col(column).alias("v"), short_key(F.lower("v")).alias("low"))
        for d in (left, right)
    ]
    return side(low[0], on, 1).join(side(low[1], on, 2), on).select(*keys, "v1", "v2")


def by_key(values: DataFrame) -> DataFrame:
    """Values with words, represented by their join keys."""
    return values.drop("v").withColumnRenamed("k", "v")


def texts_of(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of join keys ``(keys, v1, v2, score)`` with their texts instead."""
    out = pairs.select(*keys, F.col("v1").alias("k1"), F.col("v2").alias("k2"), "score")
    for n, values in ((1, left), (2, right)):
        known = values.select(*keys, F.col("k").alias(f"k{n}"), F.col("v").alias(f"v{n}"))
        out = out.join(known, [*keys, f"k{n}"])
    return out.select(*keys, "v1", "v2", "score")


# --- edit similarity -----------------------------------------------------------------------------------


def _edits(length: Column, threshold: float) -> Column:
    """Most edits a text of this length may be away from any partner at the threshold."""
    return F.floor(length * (1.0 - threshold) + _EPS)


def _piece(length: Column, threshold: float) -> Column:
    """Longest piece size that cuts the text into more pieces than it may have edits."""
    edits = _edits(length, threshold)
    return F.when(F.floor(length / 3) > edits, 3).when(F.floor(length / 2) > edits, 2).otherwise(1)


def _longest_of_size_one(threshold: float, upto: int = 400) -> int:
    """Longest text (length below ``upto``) that can only be cut into single letters."""

    def single(n: int) -> bool:
        edits = math.floor(n * (1.0 - threshold) + _EPS)
        return not (n // 3 > edits or n // 2 > edits)

    return max((n for n in range(1, upto) if single(n)), default=0)


def edit_pairs(left: DataFrame, right: DataFrame, threshold: float, keys: list[str], strict: bool) -> DataFrame:
    """``(keys, v1, v2)`` whose edit similarity reaches (``strict``: exceeds) the threshold.

    A text cut into more pieces than it has edits keeps one piece unharmed, so that piece occurs in the
    partner at nearly the same place. Only the ``edits + 1`` pieces that are rarest on the other side are
    looked up: pieces all texts share (a common prefix) drop out. Of these, the i-th may be off by at most
    ``i - 1`` from the left and ``edits + 1 - i`` from the right: were it further off, the edits spent there
    would leave another looked-up piece unharmed (G. Li et al., Pass-Join, 2011).
    """
    texts = left.filter(F.length("v") > 0).select(*keys, "v", F.length("v").alias("len"))
    texts = texts.withColumn("q", _piece(F.col("len"), threshold))
    places = F.sequence(F.lit(0), (F.floor(F.col("len") / F.col("q")) - 1).cast("int"))
    pieces = texts.select(*keys, "v", "len", "q", F.explode(places).alias("i")).select(
        *keys, "v", "len", (F.col("i") * F.col("q") + 1).alias("pos"),
        F.expr("substring(v, i * q + 1, q)").alias("gram"),
    )

    short = _longest_of_size_one(threshold)
    reach = math.ceil(short * (4.0 - threshold) / (2.0 + threshold)) if short < 399 else None
    other = spread(right.filter(F.length("v") > 0).select(*keys, "v", F.length("v").alias("len")), "v")
    sizes = F.when(F.col("len") >= 3, F.array(F.lit(2), F.lit(3))).when(F.col("len") == 2, F.array(F.lit(2)))
    sizes = F.coalesce(sizes, F.array().cast("array<int>"))
    if reach is None:
        sizes = F.concat(F.array(F.lit(1)), sizes)
    else:
        sizes = F.when(F.col("len") <= reach, F.concat(F.array(F.lit(1)), sizes)).otherwise(sizes)
    windows = (
        other.select(*keys, "v", "len", F.explode(sizes).alias("q"))
        .select(*keys, "v", "len", "q", F.explode(F.expr("sequence(1, len - q + 1)")).alias("pos"))
        .select(*keys, "v", "len", "pos", F.expr("substring(v, pos, q)").alias("gram"))
    )

    # Pieces and windows grew by exploding, which size estimates do not see: never broadcast them, and
    # leave frequent ones to the skew handling of the sort-merge join.
    on = [*keys, "gram"]
    load = windows.groupBy(*on).agg(F.count(F.lit(1)).alias("load"))
    rank = Window.partitionBy(*keys, "v").orderBy(F.coalesce("load", F.lit(0)), "pos")
    wanted = (
        pieces.join(load.hint("merge"), on, "left")
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= _edits(F.col("len"), threshold) + 1)
        .withColumn("place", F.row_number().over(Window.partitionBy(*keys, "v").orderBy("pos")))
        .filter(F.col("load").isNotNull())
        .drop("rank", "load")
    )
    joined = side(wanted, on, 1).join(side(windows, on, 2).hint("merge"), on)
    shift = F.col("pos2") - F.col("pos1")
    from_right = F.abs(shift - (F.col("len2") - F.col("len1")))
    near = (F.abs(shift) < F.col("place1")) & (
        from_right <= _edits(F.col("len1"), threshold) + 1 - F.col("place1")
    )
    hit = text.within_edit_reach("v1", "v2", threshold, strict)
    return joined.filter(near & hit).select(*keys, "v1", "v2").distinct()


# --- shared words --------------------------------------------------------------------------------------


def word_counts(values: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``(keys, v, name, c)``: the different words of each value and how often it has them."""
    words = values.select(*keys, "v", F.explode("tokens").alias(name)).filter(F.col(name) != "")
    return words.groupBy(*keys, "v", name).agg(F.count(F.lit(1)).alias("c"))


def in_other_words(words2: DataFrame, sims: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, v, x, c)``: how many words of each right value are similar to the left word ``x``."""
    return words2.join(sims, "y").groupBy(*keys, "v", "x").agg(F.sum("c").alias("c"))


def with_hits(pairs: DataFrame, words1: DataFrame, other2: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` that share similar words, with ``hits``, the number of similar word pairs.

    Words are joined with their counts, so a pair costs as many rows as its left value has different words. Both
    word tables should be stored: the planner then knows their true size and broadcasts them only when small.
    """
    on = [*keys, "x"]
    return (
        pairs.join(side(words1, on, 1), [*keys, "v1"])
        .join(side(other2, on, 2), [*on, "v2"])
        .groupBy(*pairs.columns)
        .agg(F.sum(F.col("c1") * F.col("c2")).alias("hits"))
    )


def token_pairs(
    left: DataFrame, right: DataFrame, sims: DataFrame, threshold: float, keys: list[str]
) -> DataFrame:
    """``(keys, v1, n1, v2, n2, hits)`` by similar words, with every pair whose overlap reaches the threshold.

    ``sims(x, y)`` lists the similar words, once each. All words of a value count, however many it has.

    A pair needs more than ``threshold (n1 + n2) / (1 + threshold)`` hits. Words are ordered by how many right values
    they meet. If the rarest word that a pair shares is ``x``, all its hits lie in ``x`` and the more frequent ones,
    which have at most ``held`` words, each with at most as many partners as any right value has for it (``most`` in
    all) and as this right value has for any word (``m2``). So only words for which that is enough are looked up; a
    repeated word weighs as often as it is there.
    """
    words1, words2 = stored(word_counts(left, keys, "x")), word_counts(right, keys, "y")
    other2 = stored(in_other_words(words2, sims, keys))
    share = threshold / (1.0 + threshold)

    load = other2.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("load"), F.max("c").alias("peak"))
    # the most words of one left value that are similar to the same right word; and the other way round
    double1 = words1.join(sims, "x").groupBy(*keys, "v", "y").agg(F.sum("c").alias("c"))
    double1 = double1.groupBy(*keys, "v").agg(F.max("c").alias("m"))
    double2 = other2.groupBy(*keys, "v").agg(F.max("c").alias("m"))

    order = Window.partitionBy(*keys, "v").orderBy(F.desc("load"), "x").rowsBetween(Window.unboundedPreceding, 0)
    sized1 = left.select(*keys, "v", "n").join(double1, [*keys, "v"])
    # a partner has more than n1 / (m (1 + 1 / threshold) - 1) words, or it could not take so many hits
    shortest = F.col("n") / (F.col("m") / share - 1.0)
    rare = (
        words1.join(load, [*keys, "x"])
        .withColumn("held", F.sum("c").over(order))
        .withColumn("most", F.sum(F.col("c") * F.col("peak")).over(order))
        .join(sized1, [*keys, "v"])
        .filter(F.col("most") >= share * (F.col("n") + shortest) - 1e-6)
        .select(*keys, "x", "v", "n", "m", "held", "most")
    )
    found = other2.select(*keys, "x", "v").join(right.select(*keys, "v", "n").join(double2, [*keys, "v"]), [*keys, "v"])

    on = [*keys, "x"]
    need = F.floor((F.col("n1") + F.col("n2")) * share - _EPS) + 1
    bound = F.least("most1", F.col("held1") * F.col("m2"), F.col("n1") * F.col("m2"), F.col("n2") * F.col("m1"))

    def by_rare_words(rare: DataFrame) -> DataFrame:
        met = side(rare, on, 1).join(side(found, on, 2).hint("merge"), on).filter(bound >= need)
        return with_hits(met.select(*keys, "v1", "n1", "v2", "n2").distinct(), words1, other2, keys)

    if left.count() * right.count() <= _FEW_PAIRS:
        return by_rare_words(rare)
    rare = stored(rare)
    dense = stored(_dense_keys(left, right, rare, found, keys))
    if dense.isEmpty():
        return by_rare_words(rare)
    whole = hits_in_cells(*(d.select(*keys, "v", "n") for d in (left, right)), words1, other2, dense, share, keys)
    return whole.unionByName(by_rare_words(rare.join(dense, keys, "left_anti"))) if keys else whole


def _dense_keys(left: DataFrame, right: DataFrame, rare: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, cells1, cells2)`` of the keys whose rare words meet about as often as there are pairs, as in prose."""
    one = [*keys, "__one"]
    all_ = F.lit(0).alias("__one")
    meets = [d.groupBy(*keys, "x").agg(F.count(F.lit(1)).cast("double").alias(f"c{i}")) for i, d in ((1, rare), (2, found))]
    met = meets[0].join(meets[1], [*keys, "x"]).select("*", all_).groupBy(*one).agg(F.sum(F.col("c1") * F.col("c2")).alias("met"))
    n1, n2 = (d.select(*keys, all_).groupBy(*one).agg(F.count(F.lit(1)).alias(f"n{i}")) for i, d in ((1, left), (2, right)))
    pairs = F.col("n1").cast("double") * F.col("n2")
    dense = n1.join(n2, one).join(met, one).filter((pairs > _FEW_PAIRS) & (F.col("met") * _SPARSE > pairs))
    return dense.select(*keys, *[F.ceil(F.col(f"n{i}") / _CELL).cast("int").alias(f"cells{i}") for i in (1, 2)])


def hits_in_cells(
    left: DataFrame, right: DataFrame, words1: DataFrame, other2: DataFrame, dense: DataFrame, share: float, keys: list[str]
) -> DataFrame:
    """``(keys, v1, n1, v2, n2, hits)`` of the pairs that have hits for the threshold, all pairs of ``dense`` keys being counted.

    Values of either side are dealt into lots of about a thousand; every lot meets every lot of the other side in a cell,
    where the word counts of both are multiplied. A value travels once per lot of the other side, and only pairs with
    enough hits, but no more than they have words (their score would be negative), are written out.
    """
    ids = stored(dictionary(words1.select(F.col("x").alias("term")))).toDF("x", "w")
    lots = []
    for i, j, values, words in ((1, 2, left, words1), (2, 1, right, other2)):
        counts = words.join(ids, "x").groupBy(*keys, "v").agg(F.collect_list(F.struct("w", "c")).alias("wc"))
        rows = counts.select(*keys, "v", F.col("wc.w").alias("w"), F.col("wc.c").alias("c")).join(values, [*keys, "v"])
        dealt = rows.join(F.broadcast(dense), keys) if keys else rows.crossJoin(F.broadcast(dense))
        own = F.pmod(F.xxhash64("v"), F.col(f"cells{i}")).cast("int").alias(f"cell{i}")
        other = F.explode(F.sequence(F.lit(0), F.col(f"cells{j}") - 1)).alias(f"cell{j}")
        cells = dealt.select(*keys, "v", "n", "w", "c", own, other)
        lots.append(cells.groupBy(*keys, "cell1", "cell2"))
    shape = {f.name: f for f in left.schema}
    fields = [*[f"{k} {shape[k].dataType.simpleString()}" for k in keys], "v1 string, n1 int, v2 string, n2 int, hits long"]
    names = list(keys)

    def multiply(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, hits = cell_hits(a, b, share)
        out = {k: pa.array([x.as_py()] * len(i), x.type) for k, x in zip(names, key)}
        for n, table, rows in ((1, a, i), (2, b, j)):
            out[f"v{n}"], out[f"n{n}"] = table["v"].take(pa.array(rows)), table["n"].take(pa.array(rows))
        return pa.table({**out, "hits": pa.array(hits)})

    return lots[0].cogroup(lots[1]).applyInArrow(multiply, ", ".join(fields))


def _vocabulary(values: DataFrame) -> DataFrame:
    return values.select(F.explode("tokens").alias("v")).filter("v != ''").distinct()


def literal_pairs(
    values1: DataFrame, values2: DataFrame, threshold: float, keys: list[str], as_keys: bool = False
) -> DataFrame:
    """``(keys, v1, v2, score)`` of all value pairs with ``literal_sim`` strictly above the threshold.

    With ``as_keys`` the values are given by their ``short_key``.
    """
    left, right = stored(with_tokens(values1)), stored(with_tokens(values2))
    equal = equal_pairs(left, right, keys, "k").withColumn("score", F.lit(1.0))

    worth = [d.filter("not blank") for d in (left, right)]
    many1, many2 = (by_key(d.filter("n > 1")) for d in worth)
    words = [stored(_vocabulary(d)) for d in (many1, many2)]
    sims = stored(edit_pairs(*words, threshold, [], strict=False).toDF("x", "y"))
    worded = (
        token_pairs(many1, many2, sims, threshold, keys)
        .withColumn("score", text.jaccard_ratio(F.col("hits"), F.col("n1"), F.col("n2")))
        .filter(F.col("score") > threshold)
        .select(*keys, "v1", "v2", "score")
    )

    one1, one2 = (d.filter("n <= 1").select(*keys, "v") for d in worth)
    long1, long2 = (d.filter("n > 1").select(*keys, "v") for d in worth)
    edited = (
        edit_pairs(one1, one2.unionByName(_near_length(long2, one1, threshold, keys)), threshold, keys, strict=True)
        .unionByName(edit_pairs(_near_length(long1, one2, threshold, keys), one2, threshold, keys, strict=True))
        .withColumn("score", text.string_distance_sim("v1", "v2"))
        .select(*keys, short_key("v1").alias("v1"), short_key("v2").alias("v2"), "score")
    )
    alike = worded.unionByName(edited).join(equal.drop("score"), [*keys, "v1", "v2"], "left_anti")
    found = equal.unionByName(alike)
    return found if as_keys else texts_of(found, left, right, keys)


def literal_scores(pairs: DataFrame, threshold: float) -> DataFrame:
    """``(v1, v2, score)``: ``literal_sim`` of given pairs, dissimilar ones included; words are joined, not looped over."""
    listed = stored(pairs.select("v1", "v2").dropna().distinct())
    sides = [stored(with_tokens(listed.select(F.col(f"v{i}").alias("v")).distinct())) for i in (1, 2)]
    left, right = (by_key(d.filter("n > 1")) for d in sides)
    sims = stored(edit_pairs(_vocabulary(left), _vocabulary(right), threshold, [], strict=False).toDF("x", "y"))
    known = listed.withColumns({"k1": short_key("v1"), "k2": short_key("v2")})
    for i, d in ((1, sides[0]), (2, sides[1])):
        known = known.join(d.select(F.col("k").alias(f"k{i}"), F.col("n").alias(f"n{i}"), F.col("blank").alias(f"blank{i}")), f"k{i}")
    several = known.filter("n1 > 1 and n2 > 1").select(F.col("k1").alias("v1"), F.col("k2").alias("v2"))
    words = stored(word_counts(left, [], "x")), stored(in_other_words(word_counts(right, [], "y"), sims, []))
    hits = with_hits(several, *words, [])
    score = (
        F.when(text.ci_equal("v1", "v2"), 1.0)
        .when(F.col("blank1") | F.col("blank2"), 0.0)
        .when((F.col("n1") > 1) & (F.col("n2") > 1), text.jaccard_ratio(F.coalesce("hits", F.lit(0)), F.col("n1"), F.col("n2")))
        .otherwise(text.string_distance_sim("v1", "v2"))
    )
    return known.join(hits.toDF("k1", "k2", "hits"), ["k1", "k2"], "left").select("v1", "v2", score.alias("score"))


def _near_length(values: DataFrame, others: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """Values whose length lies in reach of some of the others (long texts never meet short names)."""
    factor = (4.0 - threshold) / (2.0 + threshold)
    span = others.groupBy(*keys).agg(F.min(F.length("v")).alias("lo"), F.max(F.length("v")).alias("hi"))
    inside = F.length("v").between(F.floor(F.col("lo") / factor), F.ceil(F.col("hi") * factor))
    return values.join(span, keys).filter(inside).drop("lo", "hi")


def exact_pairs(values1: DataFrame, values2: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, v1, v2, score)`` of identical values."""
    same = values1.select(*keys, "v").join(values2.select(*keys, "v"), [*keys, "v"])
    return same.select(*keys, F.col("v").alias("v1"), F.col("v").alias("v2"), F.lit(1.0).alias("score"))
