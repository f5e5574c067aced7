"""Row filters and projections of triple and pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.config import OWL_SAME_AS, RDF_TYPE
from tripleweave.functions.terms import is_uri, local_name


def dedupe_triples(triples: DataFrame) -> DataFrame:
    return triples.dropDuplicates(["s", "p", "o"])


def drop_meta_predicates(triples: DataFrame) -> DataFrame:
    """Leaves out type statements and existing links, which would tie unlike subjects together."""
    return triples.filter(~F.col("p").isin(OWL_SAME_AS, RDF_TYPE))


def literal_triples(triples: DataFrame) -> DataFrame:
    return triples.filter(~is_uri("o"))


def uri_triples(triples: DataFrame) -> DataFrame:
    return triples.filter(is_uri("o"))


def typed_triples(triples: DataFrame, by_local_name: bool = False) -> DataFrame:
    """Type statements; ``by_local_name`` also takes ``type`` predicates of other vocabularies."""
    return triples.filter(local_name("p") == "type" if by_local_name else F.col("p") == RDF_TYPE)


def entity_names(triples: DataFrame) -> DataFrame:
    """Local names used as URI object and, once more, as subject (one row per distinct name and role)."""
    objects = uri_triples(triples).select(local_name("o").alias("term")).distinct()
    subjects = triples.select(local_name("s").alias("term")).distinct()
    return objects.unionByName(subjects)


def tag_side(triples: DataFrame, side: int) -> DataFrame:
    """Columns marked with the number of the graph."""
    return triples.toDF(*[f"{c}{side}" for c in triples.columns])


def above(df: DataFrame, threshold: float, column: str = "score", inclusive: bool = False) -> DataFrame:
    """Rows above the threshold, or at it too when ``inclusive``."""
    score: Column = F.col(column)
    return df.filter(score >= threshold if inclusive else score > threshold)


def non_reflexive(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("s1") != F.col("s2"))


def not_null_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def uri_contains(pairs: DataFrame, text: str) -> DataFrame:
    """Pairs whose both ends contain the text."""
    return pairs.filter(F.col("s1").contains(text) & F.col("s2").contains(text))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows, as a look at the data."""
    return df.limit(n)


def random_split(df: DataFrame, n: int, seed: int = 42) -> list[DataFrame]:
    """``n`` random parts of about equal size that together hold every row once."""
    return df.randomSplit([1.0] * n, seed)
