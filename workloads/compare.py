"""Runs registered queries next to their DuckDB equivalents: ``python -m workloads.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (x if math.isinf(x) else round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return tuple(_value(v) for v in x)
    return x


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_value(r[i]) for i in order) for r in rows)


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(spark, con, name: str, query, oracle: str, sf_dir: str) -> str | None:
    """Null when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    got = bag(df.columns, df.collect())
    cur = con.execute(oracle)
    want = bag([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    theirs = {d[0]: str(d[1]) for d in cur.description}
    other = {c: (t, theirs[c]) for c, t in df.dtypes if _TYPES.get(t) != theirs[c]}
    if other:
        return f"types {other}"
    if got[1] != want[1]:
        extra, missing = got[1] - want[1], want[1] - got[1]
        return (
            f"{sum(got[1].values())} rows vs {sum(want[1].values())}; only Spark {list(extra)[:3]}; only oracle {list(missing)[:3]}"
        )
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    from workloads.catalog import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                problem = differences(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
            else:
                problem = f"no oracle, {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {problem or 'ok'} ({time.time() - start:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
