"""Dictionaries, encoded triples and the sparse adjacency matrix of merged graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleweave.operators.checkpoints import spread, stored
from tripleweave.operators.skew import dealt_join


def merge_graphs(t1: DataFrame, t2: DataFrame) -> DataFrame:
    return t1.select("s", "p", "o").unionByName(t2.select("s", "p", "o"))


def dictionary(terms: DataFrame) -> DataFrame:
    """``(term, id)``: dense ids from 0 in term order, the same for the same set of terms on any cluster.

    Terms are range-partitioned and stored with the number of their range; an id is the place inside the
    range plus the sizes of the ranges before. Only one size per range meets in a single window.
    """
    ranged = stored(
        terms.select("term").distinct().repartitionByRange("term").withColumn("range", F.spark_partition_id())
    )
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("term")) - 1
    numbered = ranged.withColumn("place", place).join(shifts, "range")
    return numbered.select("term", (F.col("shift") + F.col("place")).alias("id"))


def entity_ids(triples: DataFrame) -> DataFrame:
    """Ids of all subjects and objects of a stored table; its files may be read many at a time, so it is spread first."""
    ends = spread(triples.select("s", "o"), "s", "o", rows=2 * triples.count())
    return dictionary(ends.select(F.explode(F.array("s", "o")).alias("term")))


def relation_ids(triples: DataFrame) -> DataFrame:
    """Ids of all predicates."""
    return dictionary(triples.select(F.col("p").alias("term")))


def encode_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(s, p, o, s_id, p_id, o_id)`` of two stored tables; objects that very many triples have are dealt out."""
    n = triples.count()
    with_objects = dealt_join(triples.select("s", "p", "o"), entities.toDF("o", "o_id"), ["o"], rows=n)
    return (
        spread(with_objects, "s", rows=n)
        .join(entities.toDF("s", "s_id"), "s")
        .join(relations.toDF("p", "p_id"), "p")
        .select("s", "p", "o", "s_id", "p_id", "o_id")
    )


def node_id_columns(encoded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subjects, predicates and objects of encoded triples, each next to its id."""
    return (
        encoded.select(F.col("s").alias("term"), F.col("s_id").alias("id")),
        encoded.select(F.col("p").alias("term"), F.col("p_id").alias("id")),
        encoded.select(F.col("o").alias("term"), F.col("o_id").alias("id")),
    )


def adjacency_entries(encoded: DataFrame) -> DataFrame:
    """Matrix entries ``(i, j, value)``: subject id, object id, predicate id."""
    return encoded.select(
        F.col("s_id").alias("i"), F.col("o_id").alias("j"), F.col("p_id").cast("double").alias("value")
    )


def matrix_size(entities: DataFrame) -> DataFrame:
    """Number of rows and columns of the adjacency matrix."""
    n = F.count(F.lit(1))
    return entities.agg(n.alias("rows"), n.alias("columns"))


def coordinate_matrix(entries: DataFrame, size: int):
    """The entries as a distributed ``CoordinateMatrix``."""
    from pyspark.mllib.linalg.distributed import CoordinateMatrix

    return CoordinateMatrix(entries.select("i", "j", "value").rdd.map(tuple), size, size)


def term_of_id(ids: DataFrame, wanted: int | DataFrame) -> DataFrame:
    """Terms of one id, or of a table of ids ``(id)``."""
    return ids.filter(F.col("id") == wanted) if isinstance(wanted, int) else ids.join(wanted, "id", "left_semi")


def matrix_row(entries: DataFrame, i: int | Column) -> DataFrame:
    return entries.filter(F.col("i") == i)


def matrix_cell(entries: DataFrame, i: int | Column, j: int | Column) -> DataFrame:
    return entries.filter((F.col("i") == i) & (F.col("j") == j)).select("value")
