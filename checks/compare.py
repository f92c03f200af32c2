"""Run queries on Spark and on DuckDB and compare the rows as multisets.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import oracle_queries
from checks.spark_queries import REGISTRY


TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def local_session(cpus: int | str = "*") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def compare(spark: SparkSession, connection, sf_dir: str, name: str) -> str:
    """'' when both sides agree, else what differs."""
    df = REGISTRY[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = Counter(tuple(r) for r in df.select(*columns).collect())
    sql = oracle_queries().get(name)
    if sql is None:
        return "" if ours else "no rows"
    relation = connection.execute(sql)
    theirs_columns = [d[0] for d in relation.description]
    if sorted(theirs_columns) != columns:
        return f"columns {columns} against {sorted(theirs_columns)}"
    order = [theirs_columns.index(c) for c in columns]
    our_types = [TYPES.get(df.schema[c].dataType.simpleString(), "?") for c in columns]
    their_types = [str(relation.description[i][1]) for i in order]
    if our_types != their_types:
        return f"types {list(zip(columns, our_types, their_types))}"
    theirs = Counter(tuple(row[i] for i in order) for row in relation.fetchall())
    if ours == theirs:
        return ""
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; "
        f"only ours {list((ours - theirs).items())[:2]}; only theirs {list((theirs - ours).items())[:2]}"
    )


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark, connection = local_session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        bad += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {time.time() - start:7.2f}s {name} {problem[:1200]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
