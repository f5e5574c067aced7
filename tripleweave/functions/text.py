"""Text measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleweave.functions.terms import _col

# Patterns that define what a word is.
_NOISE = r"([\p{Punct}&&[^.]]|\b\p{IsLetter}{1,2}\b)\s*"
_CAMEL = r"(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^A-Z])(?=[A-Z])|(?<=[A-Za-z])(?=[^A-Za-z])"
_BLANKS = "".join(chr(i) for i in range(1, 33))


def ci_equal(a: Column | str, b: Column | str) -> Column:
    """Equal without regard to case, and not empty."""
    a, b = _col(a), _col(b)
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.lower(a) == F.lower(b))


def clean_text(c: Column | str) -> Column:
    """Punctuation (but the dot) and words of one or two letters become blanks; trimmed."""
    return F.btrim(F.regexp_replace(_col(c), _NOISE, " "), F.lit(_BLANKS))


def split_camel(c: Column | str) -> Column:
    """Words of a camel-case name."""
    spaced = F.regexp_replace(_col(c), _CAMEL, " ")
    for _ in range(2):
        spaced = F.replace(spaced, F.lit("  "), F.lit(" "))
    return F.split(F.rtrim(spaced), " ")


def value_tokens(c: Column | str) -> Column:
    """The words of a value."""
    return F.split(clean_text(c), " ")


def name_tokens(c: Column | str) -> Column:
    """The words of a predicate name."""
    return split_camel(clean_text(c))


def string_distance_sim(a: Column | str, b: Column | str) -> Column:
    """``2 (shorter - edit distance) / (sum of lengths)``, not below 0."""
    a, b = _col(a), _col(b)
    shorter, total = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    raw = F.lit(2.0) * (shorter - F.levenshtein(a, b)) / F.nullif(total, F.lit(0))
    return F.greatest(F.lit(0.0), F.coalesce(raw, F.lit(0.0)))


def within_edit_reach(a: Column | str, b: Column | str, threshold: float, strict: bool = False) -> Column:
    """``string_distance_sim`` at or above (``strict``: above) the threshold.

    The number of edits that still reach it bounds the distance computation, which stops beyond; lengths
    that differ by more are not compared at all.
    """
    a, b = _col(a), _col(b)
    short, total = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    cap = F.floor(short - total * (threshold / 2.0) + 1e-9).cast("int")
    edits = F.call_function("levenshtein", a, b, cap)
    score = F.lit(2.0) * (short - edits) / F.nullif(total, F.lit(0))
    reached = score > threshold if strict else score >= threshold
    comparable = (total > 0) & (F.abs(F.length(a) - F.length(b)) <= cap)
    return F.when(comparable, (edits >= 0) & reached).otherwise(False)


def jaccard_ratio(hits: Column, n1: Column, n2: Column) -> Column:
    """``hits / (n1 + n2 - hits)``. Hits count word pairs, so it may leave [0, 1]; 0 below gives infinity."""
    rest = (n1 + n2 - hits).cast("double")
    return F.when(rest == 0.0, F.lit(float("inf"))).otherwise(hits / F.nullif(rest, F.lit(0.0)))


def token_hits(t1: Column, t2: Column, threshold: float) -> Column:
    """Number of word pairs of two word lists whose edit similarity reaches the threshold."""

    def partners(x: Column) -> Column:
        return F.size(F.filter(t2, lambda y: within_edit_reach(x, y, threshold)))

    return F.aggregate(t1, F.lit(0), lambda acc, x: acc + partners(x))


def literal_sim_of_tokens(a: Column, b: Column, t1: Column, t2: Column, threshold: float) -> Column:
    """``literal_sim`` for word lists that were computed before (once per distinct value)."""
    n1, n2 = F.size(t1), F.size(t2)

    def blank(t: Column) -> Column:
        return (F.size(t) == 1) & (F.get(t, F.lit(0)) == "")

    return (
        F.when(ci_equal(a, b), F.lit(1.0))
        .when(blank(t1) | blank(t2), F.lit(0.0))
        .when((n1 > 1) & (n2 > 1), jaccard_ratio(token_hits(t1, t2, threshold), n1, n2))
        .otherwise(string_distance_sim(a, b))
    )


def literal_sim(a: Column | str, b: Column | str, threshold: float) -> Column:
    """Similarity of two values: word overlap when both have several words, else edit similarity.

    For rows of short values; ``value_join.literal_scores`` joins the words of long ones.
    """
    a, b = _col(a), _col(b)
    return literal_sim_of_tokens(a, b, value_tokens(a), value_tokens(b), threshold)


def literals_equal(a: Column | str, b: Column | str, threshold: float) -> Column:
    """Value similarity strictly above the threshold."""
    return literal_sim(a, b, threshold) > threshold


def compression_ratio(total: Column, kept: Column) -> Column:
    """Share of ``kept`` in ``total`` in percent, two decimals."""
    return F.round(100.0 - (total - kept) / total * 100.0, 2)
