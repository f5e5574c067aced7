"""N-Triples text as a triple table ``(s, p, o)``; every term keeps its N-Triples spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.functions import terms
from tripleweave.operators.filters import dedupe_triples, drop_meta_predicates

# One statement per line: blanks between terms are optional where a term's end shows, a graph term may follow, then
# the closing dot and a comment, both optional. An object that is no URI, blank node or quoted literal is bare text.
_URI, _NODE = r"<[^>]*>", r"_:[^\s<\"]+"
_QUOTED = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?'
_STATEMENT = rf'^\s*({_URI}|{_NODE})\s*({_URI})\s*({_URI}|{_NODE}|{_QUOTED}|\.[^\s.].*?|[^"<\s.].*?)\s*(?:{_URI}\s*)?(?:\.\s*(?:#.*)?)?$'
_NO_STATEMENT = r"^\s*(?:#.*)?$"


def parse_statements(lines: DataFrame, column: str = "value") -> DataFrame:
    """Statement lines to triples. Comments and empty lines say nothing; for others see ``rejected_lines``."""
    line = F.col(column)
    parts = [F.regexp_extract(line, _STATEMENT, i).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"))]
    return lines.filter(~line.rlike(_NO_STATEMENT) & line.rlike(_STATEMENT)).select(*parts)


def rejected_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that are neither statements nor empty nor comments, as they are."""
    line = F.col(column)
    return lines.filter(~line.rlike(_NO_STATEMENT) & ~line.rlike(_STATEMENT))


def read_ntriples(spark: SparkSession, path: str, sep: str | None = None, drop_meta: bool = False) -> DataFrame:
    """Distinct triples of N-Triples files.

    ``sep`` names the delimiter for callers that know it; blanks and tabs are read alike anyway.
    ``drop_meta`` leaves out ``owl:sameAs`` and ``rdf:type`` as entity matching wants it. Lines that are no statements
    are left out; ``read_with_rejects`` gives them as well.
    """
    triples = dedupe_triples(parse_statements(spark.read.text(path)))
    return drop_meta_predicates(triples) if drop_meta else triples


def read_with_rejects(spark: SparkSession, path: str, drop_meta: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``read_ntriples`` gives, and ``(path, value)`` of the lines it can't read, repeated ones included."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return read_ntriples(spark, path, drop_meta=drop_meta), rejected_lines(lines).select("path", "value")


def reading_report(spark: SparkSession, path: str) -> DataFrame:
    """One row: ``lines``, and how many of them are ``statements``, ``silent`` (empty or comments) or ``rejected``."""
    line = F.col("value")
    silent, statement = line.rlike(_NO_STATEMENT), line.rlike(_STATEMENT)
    count = lambda c: F.count(F.when(c, 1))
    return spark.read.text(path).agg(
        F.count(F.lit(1)).alias("lines"), count(~silent & statement).alias("statements"),
        count(silent).alias("silent"), count(~silent & ~statement).alias("rejected"),
    )


def write_ntriples(triples: DataFrame, path: str, mode: str = "error") -> None:
    """Triples ``(s, p, o)`` as a folder of statement lines."""
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.mode(mode).text(path)


def with_term_columns(triples: DataFrame) -> DataFrame:
    """Adds what an RDF-aware reader knows: kind, text, language and datatype of the object, local names."""
    return triples.select(
        "s",
        "p",
        "o",
        terms.local_name("s").alias("s_local"),
        terms.local_name("p").alias("p_local"),
        terms.term_kind("o").alias("o_kind"),
        F.when(terms.is_uri("o"), terms.local_name("o")).alias("o_local"),
        F.when(~terms.is_uri("o"), terms.lexical_form("o")).alias("o_value"),
        terms.language("o").alias("o_lang"),
        terms.datatype("o").alias("o_datatype"),
    )
