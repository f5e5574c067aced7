"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tripleweave.operators.checkpoints import stored

#: Bytes of text that one step inside a task works on at once; a longer single text is taken alone.
BLOCK_BYTES = 2 << 20


def row_runs(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Splits rows into consecutive runs of at most ``limit`` bytes, one row at least."""
    ends = np.cumsum(sizes, dtype=np.int64)
    low, done = 0, 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield low, high
        low, done = high, int(ends[high - 1])


def text_runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of a batch's rows with their texts, null as empty."""
    texts = pc.fill_null(batch.column(batch.schema.names.index(column)), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for low, high in row_runs(sizes):
        yield batch.slice(low, high - low), texts.slice(low, high - low)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def take_lists(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``index`` of a ragged array, put together: values and offsets."""
    lengths = offsets[index + 1] - offsets[index]
    out = offsets_of(lengths)
    at = np.arange(out[-1]) + np.repeat(offsets[index] - out[:-1], lengths)
    return flat[at], out


def list_offsets(lists: pa.ListArray) -> np.ndarray:
    """Offsets of an Arrow list array into ``lists.flatten()``."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]


def typed(schema: str) -> tuple[str, pa.Schema]:
    """A DDL string with the Arrow schema of the same columns."""
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
        "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
        "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()),
    }
    fields = [part.strip().split(" ") for part in schema.split(",")]
    return schema, pa.schema([(name, kinds[kind]) for name, kind in fields])


def dense_order(df: DataFrame, by: list[Column | str], weight: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of the long column ``weight`` over all rows before this one in the order ``by``.

    Rows are dealt out by range and sorted; each task sums its own part, and only the tasks' totals, one number
    per partition, are put together. The result is a stored table.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns
    # a column for the partition must not be read by the range partitioner, so it is added after the sort
    sorted_rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())

    def sums(batches):
        before = 0
        for batch in batches:
            w = batch.column(names.index(weight)).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(w)
            at = before + total - w
            before += int(total[-1]) if len(w) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "__before"])

    schema = StructType([*sorted_rows.schema.fields, StructField("__before", LongType())])
    local = stored(sorted_rows.mapInArrow(sums, schema))
    totals = local.groupBy("__part").agg(F.sum(weight).alias("__total")).orderBy("__part").collect()  # one row per partition
    starts = np.concatenate([[0], np.cumsum([r["__total"] for r in totals])[:-1]]).tolist() if totals else []
    table = spark.createDataFrame([(r["__part"], int(s)) for r, s in zip(totals, starts)], "__part int, __start bigint")
    return (
        local.join(F.broadcast(table), "__part")
        .withColumn(name, F.col("__start") + F.col("__before"))
        .drop("__part", "__before", "__start")
    )
