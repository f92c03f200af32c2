"""Where materialised tables go.

A cluster names one folder that every executor reaches in
``spark.checkpoint.dir``. Only a local session may fall back to a temporary
folder, because only there driver and executors share a disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Root folder for checkpoints and materialised tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    active = context.getCheckpointDir()
    if active:
        return active
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="matchloom-")
    return _local_dirs[app]


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other table uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table.

    This cuts the lineage: a lost executor re-reads files instead of running the
    whole plan again, and a plan that uses the result twice computes it once.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def keyed_table(df: DataFrame, key: str, name: str) -> Iterator[DataFrame]:
    """``df`` written once in as many buckets of ``key`` as shuffles have partitions.

    Joins and groups on ``key`` read the buckets as they lie, without a shuffle, however
    often they are asked. The table's name goes when the block ends; its files stay in the
    shared folder, like those of other written tables.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key)
    writer.option("path", new_table_path(spark, name)).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
