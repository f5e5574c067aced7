"""Matching of predicate names, relation names and other term lists.

Names are compared by words. Two names above a threshold share at least one similar word, so candidates
come from an equi-join on words (:mod:`value_join`), never from the product of the two lists.
``sims`` is a table ``(x, y, sim)`` of similar words from a lexicon; words that are equal apart from case
need no lexicon and always count as similar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.config import (
    CARTESIAN_THRESHOLD,
    PREDICATE_THRESHOLD,
    RELATION_THRESHOLD,
    Thresholds,
)
from tripleweave.functions import text
from tripleweave.functions.terms import lower_ending, uri_ending
from tripleweave.operators.checkpoints import stored
from tripleweave.operators.lexicon import Lexicon, Taxonomy, vocabulary_similarity
from tripleweave.operators.value_join import (
    by_key,
    equal_pairs,
    in_other_words,
    literal_scores,
    short_key,
    side,
    texts_of,
    token_pairs,
    with_hits,
    with_tokens,
    word_counts,
)


def similar_words(words1: DataFrame, words2: DataFrame, sims: DataFrame | None, threshold: float) -> DataFrame:
    """``(x, y, sim)``: words equal apart from case (1.0) and lexicon pairs at or above the threshold."""
    equal = equal_pairs(words1, words2, []).select(
        F.col("v1").alias("x"), F.col("v2").alias("y"), F.lit(1.0).alias("sim")
    )
    if sims is None:
        return equal
    known = sims.filter((F.lower("x") != F.lower("y")) & (F.col("sim") >= threshold)).select("x", "y", "sim")
    return equal.unionByName(known)


def lexicon_words(values: DataFrame, names: bool = False) -> DataFrame:
    """``(word)``: what a lexicon is asked about for values ``v``: their words, and values of one word as they are."""
    tokens = text.name_tokens if names else text.value_tokens
    listed = values.select("v", tokens("v").alias("t"))
    words = listed.select(F.explode("t").alias("word")).unionByName(listed.filter(F.size("t") <= 1).select(F.col("v").alias("word")))
    return words.filter("word != ''").distinct()


def lexicon_sims(
    values1: DataFrame, values2: DataFrame, lexicon: Lexicon, threshold: float, names: bool = False, tree: Taxonomy | None = None
) -> DataFrame:
    """``sims (x, y, sim)`` for the words of two columns ``v``, as far as they reach the threshold, stored."""
    return stored(vocabulary_similarity(lexicon_words(values1, names), lexicon_words(values2, names), lexicon, threshold, tree))


def _words(values: DataFrame) -> DataFrame:
    return values.select(F.explode("tokens").alias("v")).filter("v != ''").distinct()


def _scored_by_words(
    left: DataFrame, right: DataFrame, sims: DataFrame | None, word_threshold: float, cut: float, keys: list[str]
) -> DataFrame:
    """Word-overlap scores of candidate pairs (both with ``tokens``), counted as joined word rows."""
    words = stored(similar_words(_words(left), _words(right), sims, word_threshold).select("x", "y").distinct())
    pairs = token_pairs(left, right, words, cut, keys).filter("n1 > 1 or n2 > 1")
    return pairs.select(*keys, "v1", "v2", text.jaccard_ratio(F.col("hits"), F.col("n1"), F.col("n2")).alias("score"))


def lexical_pairs(
    values1: DataFrame,
    values2: DataFrame,
    word_threshold: float,
    cut: float,
    sims: DataFrame | None = None,
    names: bool = False,
    keys: list[str] | None = None,
    inclusive: bool = False,
    as_keys: bool = False,
) -> DataFrame:
    """``(keys, v1, v2, score)`` above ``cut`` (at it too when ``inclusive``) for distinct values ``v``.

    ``names=True`` compares predicate names (camel-case words, word overlap as soon as one side has several
    words); otherwise values (word overlap only when both sides have several words). Single words are
    compared as a whole through ``sims``.
    """
    keys = keys or []
    tokens: Callable[[str], Column] = text.name_tokens if names else text.value_tokens
    left, right = stored(with_tokens(values1, tokens)), stored(with_tokens(values2, tokens))
    equal = stored(equal_pairs(left, right, keys, "k").withColumn("score", F.lit(1.0)))
    worth = (left, right) if names else (left.filter("not blank"), right.filter("not blank"))
    several = worth if names else tuple(d.filter("n > 1") for d in worth)
    alike = _scored_by_words(*(by_key(d) for d in several), sims, word_threshold, cut, keys)

    if sims is not None:
        whole = sims.select(F.col("x").alias("v1"), F.col("y").alias("v2"), F.col("sim").alias("score")).distinct()
        a, b = (side(d.select(*keys, "v", "k", "n"), keys, n) for n, d in ((1, worth[0]), (2, worth[1])))
        one = a.join(whole, "v1").join(b, [*keys, "v2"])
        single = (F.col("n1") <= 1) & (F.col("n2") <= 1) if names else (F.col("n1") <= 1) | (F.col("n2") <= 1)
        alike = alike.unionByName(
            one.filter(single).select(*keys, F.col("k1").alias("v1"), F.col("k2").alias("v2"), "score")
        )

    high = F.col("score") >= cut if inclusive else F.col("score") > cut
    found = equal.unionByName(alike.filter(high).join(equal.drop("score"), [*keys, "v1", "v2"], "left_anti"))
    return found if as_keys else texts_of(found, left, right, keys)


def score_pairs(
    pairs: DataFrame, word_threshold: float, sims: DataFrame | None = None, names: bool = False
) -> DataFrame:
    """``(v1, v2, score)`` of given pairs, dissimilar ones included; the measures are those of ``lexical_pairs``.

    Words are joined with their counts; word pairs are those of ``similar_words``.
    """
    tokens = text.name_tokens if names else text.value_tokens
    listed = stored(
        pairs.select("v1", "v2").dropna().distinct().select("v1", "v2", tokens("v1").alias("t1"), tokens("v2").alias("t2"))
    )
    left, right = (listed.select(F.col(f"v{i}").alias("v"), F.col(f"t{i}").alias("tokens")).distinct() for i in (1, 2))
    near = stored(similar_words(_words(left), _words(right), sims, word_threshold).select("x", "y").distinct())
    words = stored(word_counts(left, [], "x")), stored(in_other_words(word_counts(right, [], "y"), near, []))
    hits = with_hits(listed.select("v1", "v2"), *words, [])
    whole = listed.select("v1", "v2", F.lit(0.0).alias("whole"))
    if sims is not None:
        known = sims.groupBy(F.col("x").alias("v1"), F.col("y").alias("v2")).agg(F.max("sim").alias("whole"))
        whole = listed.select("v1", "v2").join(known, ["v1", "v2"])
    n1, n2 = F.size("t1"), F.size("t2")
    several = (n1 > 1) | (n2 > 1) if names else (n1 > 1) & (n2 > 1)

    def blank(t: str) -> Column:
        return (F.size(t) == 1) & (F.get(t, F.lit(0)) == "")

    score = F.when(text.ci_equal("v1", "v2"), 1.0)
    if not names:
        score = score.when(blank("t1") | blank("t2"), 0.0)
    score = score.when(several, text.jaccard_ratio(F.coalesce("hits", F.lit(0)), n1, n2)).otherwise(F.coalesce("whole", F.lit(0.0)))
    return listed.join(hits, ["v1", "v2"], "left").join(whole, ["v1", "v2"], "left").select("v1", "v2", score.alias("score"))


def predicates_equal(pairs: DataFrame, threshold: float, sims: DataFrame | None = None) -> DataFrame:
    """``(v1, v2)`` of the given name pairs that score strictly above the threshold."""
    return score_pairs(pairs, threshold, sims, names=True).filter(F.col("score") > threshold).select("v1", "v2")


def value_scores(pairs: DataFrame, limits: Thresholds, sims: DataFrame | None = None) -> DataFrame:
    """``(v1, v2, score)`` of comparable values.

    Two URI endings (marked by ``<``) are compared as names, and a score above the lexicon threshold
    becomes the string threshold; a URI ending and a literal score 0; literals are compared as values.
    """
    both = pairs.select("v1", "v2").distinct()
    marked1, marked2 = F.col("v1").startswith("<"), F.col("v2").startswith("<")
    endings = stored(
        both.filter(marked1 & marked2).select("v1", "v2", F.expr("substr(v1, 2)").alias("e1"), F.expr("substr(v2, 2)").alias("e2"))
    )
    filled = endings.filter((F.col("e1") != "") & (F.col("e2") != ""))
    named = score_pairs(filled.select(F.col("e1").alias("v1"), F.col("e2").alias("v2")), limits.lexical, sims, names=True)
    raised = F.when(F.col("score") > limits.lexical, F.lit(limits.string)).otherwise(F.col("score"))
    uris = endings.join(named.toDF("e1", "e2", "score"), ["e1", "e2"], "left").select(
        "v1", "v2", F.coalesce(raised, F.lit(0.0)).alias("score")
    )
    mixed = both.filter(marked1 != marked2).select("v1", "v2", F.lit(0.0).alias("score"))
    texts = literal_scores(both.filter(~marked1 & ~marked2), limits.string)
    return uris.unionByName(mixed).unionByName(texts)


def _distinct_predicates(triples: DataFrame) -> DataFrame:
    names = triples.select("p").distinct().select("p", uri_ending("p").alias("v"))
    return stored(names.filter(F.col("v").isNotNull()))


def _back_to_predicates(pairs: DataFrame, names1: DataFrame, names2: DataFrame) -> DataFrame:
    left = names1.select(F.col("p").alias("predicate1"), F.col("v").alias("v1"))
    right = names2.select(F.col("p").alias("predicate2"), F.col("v").alias("v2"))
    return pairs.join(left, "v1").join(right, "v2")


def equal_predicates(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """Predicate pairs with the same name ending, case included."""
    names1 = _distinct_predicates(t1).select(F.col("p").alias("predicate1"), "v")
    names2 = _distinct_predicates(t2).select(F.col("p").alias("predicate2"), "v")
    return names1.join(names2, "v").select("predicate1", "predicate2")


def scored_predicates(
    t1: DataFrame,
    t2: DataFrame,
    threshold: float = PREDICATE_THRESHOLD,
    sims: DataFrame | None = None,
    inclusive: bool = False,
    word_threshold: float | None = None,
) -> DataFrame:
    """``(predicate1, predicate2, score)`` of predicate pairs with similar names."""
    names1, names2 = _distinct_predicates(t1), _distinct_predicates(t2)
    word = threshold if word_threshold is None else word_threshold
    pairs = lexical_pairs(
        names1.select("v").distinct(), names2.select("v").distinct(), word, threshold, sims, True, None, inclusive
    )
    return _back_to_predicates(pairs, names1, names2).select("predicate1", "predicate2", "score")


def match_predicates(
    t1: DataFrame, t2: DataFrame, threshold: float = PREDICATE_THRESHOLD, sims: DataFrame | None = None
) -> DataFrame:
    """Predicate pairs of two graphs whose names are similar above the threshold."""
    return scored_predicates(t1, t2, threshold, sims).select("predicate1", "predicate2")


def match_terms(
    terms1: DataFrame,
    terms2: DataFrame,
    threshold: float = CARTESIAN_THRESHOLD,
    sims: DataFrame | None = None,
    names: bool = False,
    shown: Callable[[str], Column] = F.col,
) -> DataFrame:
    """``(term1, term2, score)`` at or above the threshold for two columns ``term``.

    ``shown`` stands for the terms in the result, such as a digest of long texts, which then don't travel with each pair.

    Rows repeated in the input stay repeated in the result: each copy of a term pairs with each copy of
    its partner, which the counts ``copies1 * copies2`` carry instead of repeated rows.
    """
    word = Thresholds.from_string(threshold).lexical
    lists = [
        stored(t.groupBy(F.col("term").alias("v")).agg(F.count(F.lit(1)).alias("copies"))) for t in (terms1, terms2)
    ]
    pairs = lexical_pairs(lists[0].select("v"), lists[1].select("v"), word, threshold, sims, names, None, True, True)
    known = [stored(d.select(short_key("v").alias(f"v{i}"), shown("v").alias(f"term{i}"), F.col("copies").alias(f"copies{i}"))) for i, d in ((1, lists[0]), (2, lists[1]))]
    return (
        pairs.join(known[0], "v1")
        .join(known[1], "v2")
        .select(
            "term1",
            "term2",
            "score",
            (F.col("copies1") * F.col("copies2")).alias("copies"),
        )
    )


def partitioned_name_scores(
    t1: DataFrame, t2: DataFrame, partitions: int, threshold: float = CARTESIAN_THRESHOLD, sims: DataFrame | None = None
) -> DataFrame:
    """Scores of both graphs' predicate names at or above the threshold, spread over ``partitions`` tasks."""
    word = Thresholds.from_string(threshold).lexical
    scored = scored_predicates(t1, t2, threshold, sims, True, word)
    return scored.repartition(partitions, "predicate1", "predicate2")


def similar_relations(
    relations: DataFrame, sims: DataFrame | None = None, threshold: float = RELATION_THRESHOLD
) -> DataFrame:
    """Pairs ``(term1, id1, term2, id2, score)`` of a relation dictionary with similar lower-case endings."""
    names = stored(relations.select("term", "id", lower_ending("term").alias("v")))
    distinct = names.select("v").distinct()
    pairs = lexical_pairs(distinct, distinct, threshold, threshold, sims, names=True)
    left = names.select(F.col("term").alias("term1"), F.col("id").alias("id1"), F.col("v").alias("v1"))
    right = names.select(F.col("term").alias("term2"), F.col("id").alias("id2"), F.col("v").alias("v2"))
    return pairs.join(left, "v1").join(right, "v2").select("term1", "id1", "term2", "id2", "score")
