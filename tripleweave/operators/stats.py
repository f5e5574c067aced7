"""Graph statistics: counts, histograms and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.config import OWL_SAME_AS, RDF_TYPE
from tripleweave.functions.terms import is_uri
from tripleweave.operators.filters import typed_triples


def _count(name: str):
    return F.count(F.lit(1)).alias(name)


def count_typed(triples: DataFrame) -> DataFrame:
    return typed_triples(triples).agg(_count("typed_triples"))


def _with_total(counts: DataFrame, key: str) -> DataFrame:
    """Adds the ``SUM`` row from the counts, so the triples are read and shuffled once."""
    total = counts.agg(F.lit("SUM").alias(key), F.coalesce(F.sum("triples"), F.lit(0)).alias("triples"))
    return counts.unionByName(total)


def type_histogram(triples: DataFrame) -> DataFrame:
    """Statements per class, and their total in the row ``SUM``."""
    return _with_total(typed_triples(triples).groupBy("o").agg(_count("triples")), "o")


def subject_type_histogram(triples: DataFrame) -> DataFrame:
    """Type statements per subject, and their total in the row ``SUM``."""
    return _with_total(typed_triples(triples).groupBy("s").agg(_count("triples")), "s")


def untyped_subjects(triples: DataFrame) -> DataFrame:
    """Distinct subjects without a type statement."""
    typed = F.max(F.col("p") == RDF_TYPE).alias("typed")
    return triples.groupBy("s").agg(typed).filter(~F.col("typed")).select("s")


def count_same_as(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("p") == OWL_SAME_AS).groupBy("p").agg(_count("triples"))


def subject_degree(triples: DataFrame) -> DataFrame:
    return triples.groupBy("s").agg(_count("triples"))


def predicate_frequency(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(_count("triples"))


def graph_profile(triples: DataFrame) -> DataFrame:
    """One row per measure ``(measure, n)``.

    Distinct terms are counted as group-by of ``(measure, term)`` with partial aggregation, so a term
    that fills much of a graph is folded on the map side and no task holds a set of terms.
    """
    typed = F.col("p") == RDF_TYPE

    def item(name: str, term):
        return F.struct(F.lit(name).alias("measure"), term.alias("term"))

    items = F.array(
        item("predicates", F.col("p")),
        item("subjects", F.col("s")),
        item("entities", F.col("s")),
        item("entities", F.col("o")),
        item("literals", F.when(~is_uri("o"), F.col("o"))),
        item("uri_objects", F.when(is_uri("o"), F.col("o"))),
        item("classes", F.when(typed, F.col("o"))),
        item("typed_subjects", F.when(typed, F.col("s"))),
    )
    names = ["triples", "typed_triples", "predicates", "subjects", "entities", "literals", "uri_objects",
             "classes", "typed_subjects"]
    distinct = (
        triples.select(F.inline(items))
        .filter(F.col("term").isNotNull())
        .groupBy("measure", "term")
        .agg(F.lit(1).alias("one"))
        .groupBy("measure")
        .agg(_count("n"))
    )
    rows = triples.agg(
        F.count(F.lit(1)).alias("triples"), F.count(F.when(typed, 1)).alias("typed_triples")
    ).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("n")) for c in ("triples", "typed_triples")
    ])))
    zero = triples.sparkSession.createDataFrame([(n,) for n in names], "measure string")
    counted = distinct.unionByName(rows)
    return zero.join(counted, "measure", "left").select("measure", F.coalesce("n", F.lit(0)).alias("n"))


def type_pair_counts(t1: DataFrame, t2: DataFrame) -> DataFrame:
    """Size of the join of both graphs' type statements per class pair.

    Counted per class before the join: the rows joined are classes, not statements.
    """

    def classes(t: DataFrame, side: int) -> DataFrame:
        return typed_triples(t).groupBy("p", F.col("o").alias(f"type{side}")).agg(_count(f"n{side}"))

    joined = classes(t1, 1).join(classes(t2, 2), "p")
    return joined.select("type1", "type2", (F.col("n1") * F.col("n2")).alias("pairs"))


def rank_predicates(t1: DataFrame, t2: DataFrame, pairs: DataFrame) -> DataFrame:
    """Joined statements per matched predicate pair, largest first (counts are multiplied, not joined)."""
    n1 = predicate_frequency(t1).toDF("predicate1", "n1")
    n2 = predicate_frequency(t2).toDF("predicate2", "n2")
    return (
        pairs.join(n1, "predicate1")
        .join(n2, "predicate2")
        .select("predicate1", "predicate2", (F.col("n1") * F.col("n2")).alias("pairs"))
        .orderBy(F.desc("pairs"), "predicate1", "predicate2")
    )
