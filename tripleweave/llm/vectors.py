"""Rows of vectors packed into blocks for array work in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleweave.llm.common import stored


def usable(column: str = "embedding") -> Column:
    """Whether a vector is there and holds no null or non-finite component."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)), F.lit(False))


def matrix(lists: pa.Array) -> np.ndarray:
    """A list column whose rows are equally long as float64 rows."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1) if len(values) else np.zeros((len(lists), 0))


def doubles(blob: bytes, rows: int) -> np.ndarray:
    values = np.frombuffer(blob, np.float64)
    return values.reshape(rows, -1) if rows and len(values) else np.zeros((rows, 0))


def blocks(vectors: DataFrame, size: int, keys: list[str] | None = None) -> DataFrame:
    """``vec_id, embedding`` rows put together by hash: ``dim, *keys, block, n, ids, vecs``, as a stored table.

    A block has about ``size`` rows of one dimension (and of equal ``keys``); larger groups have more blocks, so none is
    gathered whole. ids are int64 and vecs float64 bytes.
    """
    keys = keys or []
    sized = vectors.withColumn("dim", F.size("embedding"))
    counts = stored(sized.groupBy("dim", *keys).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).alias("parts")))
    dealt = sized.join(counts, ["dim", *keys]).withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts")).cast("int"))

    def pack(key, table):
        vectors = table.column("embedding").combine_chunks()
        ids = table.column("vec_id").to_numpy().astype(np.int64)
        own = {name: pa.array([value.as_py()]) for name, value in zip(["dim", *keys, "block"], key)}
        return pa.table({**own, "n": [len(ids)], "ids": [ids.tobytes()], "vecs": [matrix(vectors).tobytes()]}).cast(arrow)

    kinds = {"dim": pa.int32(), "block": pa.int32(), "n": pa.int32(), "ids": pa.binary(), "vecs": pa.binary()}
    names = ["dim", *keys, "block", "n", "ids", "vecs"]
    arrow = pa.schema([(name, kinds.get(name, pa.int32())) for name in names])
    ddl = ", ".join(f"{name} {'binary' if kinds.get(name) == pa.binary() else 'int'}" for name in names)
    return stored(
        dealt.select("dim", *keys, "block", "vec_id", "embedding").groupBy("dim", *keys, "block").applyInArrow(pack, ddl)
    )
