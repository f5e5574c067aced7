"""Entity alignment of two triple tables ``(s, p, o)``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.config import PARENT_THRESHOLD, PREDICATE_THRESHOLD
from tripleweave.functions.terms import comparable_value, is_uri, lexical_form, local_name, uri_ending
from tripleweave.operators.blocking import (
    blocked_side,
    common_predicate_clusters,
    profile_pairs,
    profiles,
    with_block,
)
from tripleweave.operators.checkpoints import stored
from tripleweave.operators.classes import of_members, value_classes
from tripleweave.operators.evaluate import compression
from tripleweave.operators.filters import drop_meta_predicates, dedupe_triples, entity_names, literal_triples, non_reflexive
from tripleweave.operators.lexicon import Lexicon, Taxonomy, vocabulary_similarity
from tripleweave.operators.matching import keyed, match_leaves, partner_values, similar_values, without_lowest
from tripleweave.operators.neighbours import neighbour_triples, substitute_matched, untouched_triples
from tripleweave.operators.skew import dealt_join
from tripleweave.operators.predicates import equal_predicates, lexicon_words, match_predicates, match_terms


def prepare(triples: DataFrame, drop_meta: bool = True) -> DataFrame:
    """Distinct triples, without type and link statements unless ``drop_meta`` is off."""
    triples = dedupe_triples(triples)
    return drop_meta_predicates(triples) if drop_meta else triples


def predicate_pairs(
    t1: DataFrame, t2: DataFrame, exact: bool = False, threshold: float = PREDICATE_THRESHOLD,
    sims: DataFrame | None = None,
) -> DataFrame:
    """Matched predicates by similar name, or by equal name when ``exact``."""
    return equal_predicates(t1, t2) if exact else match_predicates(t1, t2, threshold, sims)


def graph_sims(t1: DataFrame, t2: DataFrame, lexicon: Lexicon, threshold: float, tree: Taxonomy | None = None) -> DataFrame:
    """``sims`` of the words in both graphs' predicate names and values, for ``align_entities`` and the comparisons.

    ``threshold`` is the least that any step asks of two words; steps that ask for more filter the table.
    """
    sides = []
    for t in (t1, t2):
        names = lexicon_words(t.select(uri_ending("p").alias("v")).filter("v is not null").distinct(), names=True)
        values = lexicon_words(t.select(comparable_value("o").alias("v")).filter("v is not null").distinct())
        sides.append(names.unionByName(values).distinct())
    return stored(vocabulary_similarity(*sides, lexicon, threshold, tree))


def cluster_subjects(t1: DataFrame, t2: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters of subjects by number of shared literal predicates, in factored form."""
    pairs = stored(with_block(pairs))
    sides = [blocked_side(literal_triples(t), pairs, n) for n, t in ((1, t1), (2, t2))]
    return common_predicate_clusters(*sides)


def blocking_evaluation(t1: DataFrame, t2: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Clusters over all statements, URIs included, in factored form."""
    pairs = stored(with_block(predicate_pairs(t1, t2) if pairs is None else pairs))
    return common_predicate_clusters(blocked_side(t1, pairs, 1), blocked_side(t2, pairs, 2))


def align_entities(
    t1: DataFrame, t2: DataFrame, pairs: DataFrame | None = None, mode: str = "string",
    skip_lowest: bool = False, sims: DataFrame | None = None, min_shared: int = 1, exclusive: bool = False,
) -> DataFrame:
    """Matches ``(s1, s2, score)`` of two prepared graphs by their literal values; for the options see ``match_sides``."""
    pairs = predicate_pairs(t1, t2, sims=sims) if pairs is None else pairs
    return match_leaves(literal_triples(t1), literal_triples(t2), pairs, mode, skip_lowest, sims, min_shared, exclusive)


def similar_subjects(side1: DataFrame, side2: DataFrame, normed: bool = False) -> DataFrame:
    """Subject pairs with similar values in some block, with their best score.

    Values are joined by similarity per block and carried back to the subjects; the block table is not
    formed. The result has one row for every pair that shares a value, however frequent that value is. Subjects with equal
    values are looked up as one (``value_classes``); their pairs are written out at the end. ``normed`` gives the mean score
    of a pair's similar values instead, if it is above the parent threshold.
    """
    side1, side2, *members = value_classes(side1, side2)
    return of_members(similar_classes(side1, side2, normed), *members)


def similar_classes(side1: DataFrame, side2: DataFrame, normed: bool = False) -> DataFrame:
    """``similar_subjects`` of the sides that ``value_classes`` gives: pairs of classes, not written out.

    The rows of frequent values are dealt out by their counts.
    """
    similar = stored(similar_values(side1, side2, as_keys=True))
    side1, side2 = keyed(side1), keyed(side2)
    right = stored(side2.select(F.col("s").alias("s2"), "b", "v", F.col("m").alias("m2")))
    if not normed:
        partners = stored(partner_values(side1, similar).select("s1", "b", "v", "top"))
        rows = dealt_join(partners, right, ["b", "v"])
        return non_reflexive(rows).groupBy("s1", "s2").agg(F.max("top").alias("score"))
    held = side1.select(F.col("s").alias("s1"), "b", F.col("v").alias("v1"), "m")
    partners = stored(held.join(similar, ["b", "v1"]).select("s1", "b", F.col("v2").alias("v"), "m", "score"))
    rows = non_reflexive(dealt_join(partners, right, ["b", "v"]))
    copies = F.col("m") * F.col("m2")
    mean = F.sum(F.col("score") * copies) / F.sum(copies)
    return rows.groupBy("s1", "s2").agg(mean.alias("score")).filter(F.col("score") > PARENT_THRESHOLD)


def value_level_matches(t1: DataFrame, t2: DataFrame, pairs: DataFrame, skip_lowest: bool = False) -> DataFrame:
    """``(s1, s2, score)`` of all subject pairs with one pair of similar literals, with ``skip_lowest`` but the lowest level.

    These are the rows before scores are summed per pair; there is one for every pair that shares a value.
    """
    pairs = stored(with_block(pairs))
    sides = [stored(blocked_side(literal_triples(t), pairs, n)) for n, t in ((1, t1), (2, t2))]
    found = similar_subjects(*sides)
    if not skip_lowest:
        return found
    tables = [stored(profiles(d)) for d in sides]
    levels = stored(profile_pairs(*tables).select("profile1", "profile2", F.col("predicates").alias("count")))
    kept = without_lowest(levels, levels).select("profile1", "profile2")
    return (
        found.join(tables[0].toDF("s1", "profile1"), "s1")
        .join(tables[1].toDF("s2", "profile2"), "s2")
        .join(kept, ["profile1", "profile2"])
        .select("s1", "s2", "score")
    )


@dataclass(frozen=True)
class _Around:
    """Triples around the matches so far: of graph 1 with matched terms replaced, and of graph 2."""

    left: DataFrame
    right: DataFrame


def deduce_relations(
    t1: DataFrame, t2: DataFrame, matches: DataFrame, rounds: int | None = 1, sims: DataFrame | None = None,
    earlier: DataFrame | None = None, mode: str = "any",
) -> DataFrame:
    """Matches extended through the neighbourhood, ``(s1, s2, score, stage)``.

    Per round: triples around the matches on both sides, matched terms of graph 1 replaced by their partners, predicates
    matched, and subjects with a similar value become matches (``any``), or those whose similar values have a mean score
    above the parent threshold (``normed``). ``earlier`` adds pairs known from single values (``value_level_matches``) to
    the result of the first round. ``rounds=None`` goes on until a round finds nothing new.

    Rounds are semi-naive: only what the last round found widens the neighbourhood, and only triples that are new there,
    or that changed because a term of theirs was matched, are compared, with everything known of the other side. Two
    triples that were there before have been compared before, so nothing is missed. ``normed`` weighs all similar values
    of a pair, so it compares a round's whole neighbourhood. Each round's tables are stored, so a lost executor costs
    part of a round at most. Subjects with equal values are compared as one; the pairs of the last of ``rounds`` are only
    written out where the result is read, from stored classes.
    """
    t1, t2 = stored(t1.select("s", "p", "o")), stored(t2.select("s", "p", "o"))
    known = stored(matches.select("s1", "s2", "score", F.lit(0).alias("stage")))
    last, before, stage = known, None, 0
    while rounds is None or stage < rounds:
        stage += 1
        around, new1, new2 = _widened(t1, t2, known, last, before)
        pairs = stored(with_block(match_predicates(around.left, around.right, sims=sims)))
        side1, side2 = stored(blocked_side(around.left, pairs, 1)), stored(blocked_side(around.right, pairs, 2))
        if before is not None and mode != "normed":
            side1, side2 = _marked(side1, blocked_side(new1, pairs, 1)), _marked(side2, blocked_side(new2, pairs, 2))
        side1, side2, *members = value_classes(side1, side2)
        if before is None or mode == "normed":
            found = similar_classes(side1, side2, normed=mode == "normed")
        else:
            both = similar_classes(side1.filter("new"), side2).unionByName(similar_classes(side1, side2.filter("new")))
            found = both.groupBy("s1", "s2").agg(F.max("score").alias("score"))
        new = of_members(found, *members)  # no matched subject is left in ``around.left``, so none of these is known
        if earlier is not None and stage == 1:
            both = new.unionByName(earlier.select("s1", "s2", "score"))
            found = both.groupBy("s1", "s2").agg(F.max("score").alias("score"))
            new = found.join(known.select("s1", "s2"), ["s1", "s2"], "left_anti")
        last = new.select("s1", "s2", "score", F.lit(stage).alias("stage"))
        if stage == rounds:
            return known.unionByName(last)
        last = stored(last)
        known, before = known.unionByName(last), around
        if last.isEmpty():
            break
    return known


def _marked(side: DataFrame, fresh: DataFrame) -> DataFrame:
    """A ``blocked_side`` table with ``new``: whether the row's value is one of ``fresh``, a part of it."""
    rows = fresh.select("s", "b", "v", F.lit(True).alias("new"))
    return stored(side.join(rows, ["s", "b", "v"], "left").withColumn("new", F.coalesce("new", F.lit(False))))


def _widened(
    t1: DataFrame, t2: DataFrame, known: DataFrame, last: DataFrame, before: _Around | None
) -> tuple[_Around, DataFrame, DataFrame]:
    """The neighbourhood after the matches ``last``, and what is new in it on either side.

    All triples that hold a newly matched subject lie in its neighbourhood, so replacing terms there brings the rest
    up to date as well; the old forms of those triples go.
    """
    near1 = substitute_matched(stored(neighbour_triples(t1, last.select(F.col("s1").alias("s")))), known)
    near2 = neighbour_triples(t2, last.select(F.col("s2").alias("s")))
    if before is None:
        around = _Around(stored(near1.distinct()), stored(near2))
        return around, around.left, around.right
    new1 = stored(near1.distinct().join(before.left, ["s", "p", "o"], "left_anti"))
    new2 = stored(near2.join(before.right, ["s", "p", "o"], "left_anti"))
    left = stored(untouched_triples(before.left, last).unionByName(new1).distinct())
    return _Around(left, stored(before.right.unionByName(new2))), new1, new2


# --- whole-graph term comparison -----------------------------------------------------------------------


def compare_predicates(t1: DataFrame, t2: DataFrame, sims: DataFrame | None = None) -> DataFrame:
    """Similar predicate local names of two graphs."""
    names = [t.select(local_name("p").alias("term")).distinct() for t in (t1, t2)]
    return match_terms(*names, sims=sims, names=True)


def compare_literals(
    t1: DataFrame, t2: DataFrame, sims: DataFrame | None = None, shown: Callable[[str], Column] = F.col
) -> DataFrame:
    """Similar literal values of two graphs; for ``shown`` see ``match_terms``."""
    values = [
        t.filter(~is_uri("o") & ~F.col("o").startswith("_:")).select(lexical_form("o").alias("term")).distinct()
        for t in (t1, t2)
    ]
    return match_terms(*values, sims=sims, shown=shown)


def compare_entities(t1: DataFrame, t2: DataFrame, sims: DataFrame | None = None) -> DataFrame:
    """Similar local names of the entities of two graphs."""
    return match_terms(entity_names(t1), entity_names(t2), sims=sims)


def predicate_compression(t1: DataFrame, t2: DataFrame, sims: DataFrame | None = None) -> DataFrame:
    """Compression reached by merging similar predicate names."""
    names = [t.select(local_name("p").alias("term")).distinct() for t in (t1, t2)]
    return compression(*names, match_terms(*names, sims=sims, names=True))
