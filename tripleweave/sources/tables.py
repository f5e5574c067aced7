"""Pair tables, match tables, gold alignments and stored intermediate results."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.config import ALIGNMENT_NS

_PAIR_SCHEMA = "predicate1 string, predicate2 string"


def read_predicate_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated matched predicates ``(predicate1, predicate2)``."""
    return spark.read.schema(_PAIR_SCHEMA).csv(path, sep="\t", comment="#")


def write_pairs(df: DataFrame, path: str, mode: str = "error") -> None:
    """Pairs or clusters as a folder of tab-separated files."""
    df.write.mode(mode).csv(path, sep="\t")


def write_matches(df: DataFrame, path: str, mode: str = "error") -> None:
    """Match rows as comma-separated text."""
    df.write.mode(mode).csv(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when a finished result lies at ``path`` (any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS"))


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Reads the table stored at ``path``; when it is missing, computes and stores it first.

    The caller picks a path per input, so a stored table is never taken for other inputs. An
    unfinished write has no success marker and is written again.
    """
    if not path_exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def input_files(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """``(path, bytes, time of change)`` of all files below the paths, in order; hidden files don't count."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(conf).listFiles(target, True)
        while files.hasNext():
            status = files.next()
            if not status.getPath().getName().startswith(("_", ".")):
                found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def stored_result(
    spark: SparkSession, folder: str, name: str, inputs: list[str], compute: Callable[[], DataFrame], settings: str = ""
) -> DataFrame:
    """The table ``name`` that ``compute`` makes of the files below ``inputs``, computed only if it isn't there yet.

    What is stored in ``folder`` is kept by a digest of the inputs' paths, sizes and times and of ``settings``
    (thresholds and the like), so a result is never taken for other inputs, and changed inputs are computed anew beside
    the old result. The inputs are listed in the table ``<name>-<digest>-inputs``, which is written last but one; a
    result without its success marker is written again.
    """
    files = input_files(spark, *inputs)
    digest = hashlib.sha256(repr((files, settings)).encode()).hexdigest()[:32]
    path = f"{folder.rstrip('/')}/{name}-{digest}"
    if not path_exists(spark, path):
        spark.createDataFrame(files, "path string, bytes bigint, changed bigint").write.mode("overwrite").parquet(f"{path}-inputs")
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Blank-separated ``<uri1> <uri2> score`` lines as distinct pairs ``(s1, s2)``."""
    rows = spark.read.schema("s1 string, s2 string, score string").csv(path, sep=" ")
    return rows.select("s1", "s2").dropDuplicates()


def alignment_cells(triples: DataFrame) -> DataFrame:
    """Pairs of an RDF alignment: both entities of a cell node, with its measure."""
    wanted = ["entity1", "entity2", "measure"]
    picked = triples.filter(F.col("p").isin([f"<{ALIGNMENT_NS}{w}>" for w in wanted]))
    cells = picked.groupBy("s").agg(
        *[F.max(F.when(F.col("p") == f"<{ALIGNMENT_NS}{w}>", F.col("o"))).alias(w) for w in wanted]
    )
    return (
        cells.filter(F.col("entity1").isNotNull() & F.col("entity2").isNotNull())
        .select(
            F.col("entity1").alias("s1"),
            F.col("entity2").alias("s2"),
            F.regexp_extract("measure", r'"?([0-9.]+)', 1).try_cast("double").alias("measure"),
        )
        .dropDuplicates()
    )


def predicate_histogram(triples: DataFrame) -> DataFrame:
    """Triples per predicate, most frequent first."""
    counts = triples.groupBy("p").agg(F.count(F.lit(1)).alias("triples"))
    return counts.orderBy(F.desc("triples"), "p")


def write_predicate_histogram(triples: DataFrame, path: str, mode: str = "error") -> None:
    """Stores the sorted predicate counts."""
    predicate_histogram(triples).write.mode(mode).csv(path, sep="\t")
