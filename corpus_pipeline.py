"""Documents to packed token sequences: language ID, near dedup, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.llm import langid, near_copies, packing, sentence_spans, simhash
from tripleweave.llm.common import stored
from tripleweave.llm.queries import WORD_VOCABULARY

#: SQL has no byte-pair encoding and no XXH64; the stages are tested against brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier, learnt from ``docs``, does not reject."""
    columns = docs.columns
    found = langid.classify(docs, langid.fit(docs))
    return found.filter(~F.col("rejected")).select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id.

    Near are fingerprints within op2's radius, found by its balls of variants, and texts of five-word Jaccard 0.8 or
    more, found by bands of least hashes: edited copies differ in more bits than the balls reach.
    """
    rows = near_copies.described(docs)
    return simhash.survivors(docs, rows=rows, also=near_copies.links(rows, docs))


def without_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that an earlier one has; ``n_chars`` follows. Every document stays."""
    columns = docs.columns
    cleaned = sentence_spans.remove_repeats(docs)
    cut = F.size("removed") > 0
    changed = cleaned.withColumn("n_chars", F.when(cut, F.char_length("clean_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.withColumn("text", F.col("clean_text")).select(*columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the sequences of 4096 tokens."""
    return packing.pack_pieces(packing.token_pieces(docs, WORD_VOCABULARY))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", without_repeated_spans),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
