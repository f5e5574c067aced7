"""Joins whose frequent keys are split by counts measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleweave.operators.checkpoints import spread, stored, tasks_for


def key_ways(left: DataFrame, right: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """``(*keys, ways1, ways2)`` of the keys whose joined rows are more than a task's share; others have no row.

    A key with ``n1`` and ``n2`` rows makes ``n1 * n2``. A task's share is all joined rows over the number of tasks. A key
    of so many shares is cut into a grid of about as many cells, ``ways1`` by ``ways2``, more on its larger side, so that
    either side is repeated no more often than the other is cut. Counts are aggregated before they meet.
    """
    counts = [d.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{i}")) for i, d in ((1, left), (2, right))]
    met = stored(counts[0].join(counts[1], keys).withColumn("made", F.col("n1").cast("double") * F.col("n2")))
    share = met.agg((F.sum("made") / F.lit(float(tasks))).alias("share")).scalar()
    heavy = met.filter(F.col("made") > share).withColumn("cells", F.col("made") / share)
    ways1 = F.greatest(F.lit(1.0), F.least(F.col("n1").cast("double"), F.ceil(F.sqrt(F.col("cells") * F.col("n1") / F.col("n2")))))
    ways2 = F.greatest(F.lit(1.0), F.least(F.col("n2").cast("double"), F.ceil(F.sqrt(F.col("cells") * F.col("n2") / F.col("n1")))))
    return heavy.select(*keys, ways1.cast("int").alias("ways1"), ways2.cast("int").alias("ways2"))


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int = 0) -> DataFrame:
    """The inner equi-join of two stored tables on ``keys``, with the rows of frequent keys dealt out over tasks.

    Keys are counted on both sides first. Rows of a key that makes more than a task's share of the result go to a cell of
    its grid: a side's row takes its own line of the grid by its hash and is repeated along the other direction. All other
    rows are joined as they are. There are at most as many frequent keys as tasks, so their table is small by itself.
    ``rows``, if given, is the number of rows to expect; the join then runs in as many tasks as that asks for.
    """
    tasks = tasks_for(left.sparkSession, rows)
    ways = F.broadcast(stored(key_ways(left, right, keys, tasks)))

    def cells(side: DataFrame, own: str, other: str) -> DataFrame:
        """A grid cell per row and repetition; cell (0, 0) for keys that aren't frequent."""
        held = side.join(ways, keys, "left")
        line = F.coalesce(F.pmod(F.xxhash64(*side.columns), F.col(own)), F.lit(0)).cast("int")
        along = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        places = {own: line, other: along}
        return held.select(*side.columns, places["ways1"].alias("__cell1"), places["ways2"].alias("__cell2"))

    on = [*keys, "__cell1", "__cell2"]
    first = cells(left, "ways1", "ways2")
    first = spread(first, *on, rows=rows) if rows else first
    return first.join(cells(right, "ways2", "ways1"), on).drop("__cell1", "__cell2")
