"""Writing tables: replace, append, and add only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from matchloom.operators.quality import keep_first_by_key
from matchloom.operators.scale import is_small
from matchloom.storage import materialize

DEFAULT_BUCKETS = 64
# Rows that one task of an append writes, about.
FILE_ROWS = 1_000_000


def replace_table(df: DataFrame, path: str, *, sort_by: str | None = None) -> None:
    """Overwrite; sorting inside the tasks lets readers skip row groups on that column."""
    if sort_by:
        df = df.sortWithinPartitions(sort_by)
    df.write.mode("overwrite").parquet(path)


def with_bucket(df: DataFrame, key: str = "nct_id", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def append_chunks(
    df: DataFrame,
    path: str,
    *,
    key: str = "nct_id",
    chunk_id: str = "chunk_id",
    buckets: int = DEFAULT_BUCKETS,
    files_per_bucket: int = 1,
) -> None:
    """Append chunk rows to ``bucket=`` folders chosen by a hash of ``key``.

    A bucket is written by ``files_per_bucket`` tasks, chosen by a hash of the chunk
    id, so one trial with very many chunks is not one task's work.
    """
    part = F.pmod(F.xxhash64(chunk_id), F.lit(files_per_bucket))
    (
        with_bucket(df, key, buckets)
        .withColumn("_part", part)
        .repartition("bucket", "_part")
        .drop("_part")
        .write.mode("append")
        .partitionBy("bucket")
        .parquet(path)
    )


def stored_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None before the first append."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def new_chunks(
    incoming: DataFrame,
    stored: DataFrame | None,
    *,
    chunk_id: str = "chunk_id",
    order: str | None = None,
) -> DataFrame:
    """Incoming rows whose chunk id is neither stored nor earlier in the batch.

    A chunk id counts as stored wherever it is: under another key or another number of
    buckets too, and whatever the size of the batch. Only ids are read from the store.
    """
    first = keep_first_by_key(incoming, [chunk_id], [order or chunk_id])
    if stored is None:
        return first
    known = stored.select(chunk_id)
    ids = incoming.select(chunk_id).distinct()
    if is_small(ids):  # the store is not shuffled then
        known = known.join(F.broadcast(ids), chunk_id, "left_semi")
    return first.join(known, chunk_id, "left_anti")


def add_new_chunks(
    incoming: DataFrame, path: str, *, buckets: int = DEFAULT_BUCKETS, **layout
) -> None:
    """Append the rows of ``incoming`` that are not stored yet. Repeating it is safe.

    ``incoming`` is computed once. The number of files follows from its rows.
    """
    rows = materialize(incoming, "incoming")
    fresh = new_chunks(rows, stored_chunks(rows.sparkSession, path))
    layout.setdefault("files_per_bucket", -(-rows.count() // (buckets * FILE_ROWS)) or 1)
    append_chunks(fresh, path, buckets=buckets, **layout)
