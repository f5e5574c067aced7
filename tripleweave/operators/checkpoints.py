"""Storing intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []  # what this session has put into the folder
_ROWS_OF_TASK = 500_000  # most rows that one task makes of a spread table


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset, a local session uses a folder of its warehouse; on a cluster that would be a folder of one
    machine, so the setting is asked for.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tripleweave-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that is not in use yet, and that ``clear_stored`` will remove."""
    path = f"{checkpoint_folder(spark).rstrip('/')}/tripleweave-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def spread(df: DataFrame, *columns: str, rows: int = 0) -> DataFrame:
    """Hash-partitions a compact table over all tasks before a step that multiplies its rows or is heavy per row.

    ``rows`` is how many rows that step makes of the table, see ``tasks_for``.
    """
    return df.repartition(tasks_for(df.sparkSession, rows), *columns)


def tasks_for(spark: SparkSession, rows: int = 0) -> int:
    """The session's number of shuffle partitions, or more: so many that a task's share of ``rows`` does not grow with them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // _ROWS_OF_TASK))


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the checkpoint folder and reads on from there.

    For tables that feed several later steps: they are computed once, a lost executor costs only what
    came after, and the planner knows their true size, so joins with small ones broadcast and others do not.
    Results read from stored tables need them; call ``clear_stored`` when they are written elsewhere.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> int:
    """Removes everything this session has stored so far, and gives the number of tables. Results that are not written
    elsewhere can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done
