"""New trial documents picked up by a file stream and added to the chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from matchloom.operators.chunking import DEFAULT_MAX_LENGTH, chunk_documents
from matchloom.plans.search import extend_search_index
from matchloom.sources.sinks import add_new_chunks


def read_documents(
    spark: SparkSession, folder: str, schema: str = "nct_id string, document string",
    *, files_per_batch: int = 1000,
) -> DataFrame:
    """A stream over parquet files that arrive in ``folder``."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def follow_documents(
    documents: DataFrame,
    path: str,
    *,
    checkpoint: str,
    max_length: int = DEFAULT_MAX_LENGTH,
    keep: tuple[str, ...] = (),
    **layout,
) -> StreamingQuery:
    """Chunk every new document and add its chunks to the table at ``path``.

    Each micro-batch goes through the same function as a batch load. It skips chunk
    ids that are stored already, so a batch repeated after a failure adds nothing.
    ``checkpoint`` is a lasting folder: a restarted stream goes on from it.
    Chunking needs no state and there is no event time, hence no watermark.
    """
    def add(batch: DataFrame, _epoch: int) -> None:
        add_new_chunks(chunk_documents(batch, keep=keep, max_length=max_length), path, **layout)

    return (
        documents.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def follow_into_index(
    documents: DataFrame,
    path: str,
    *,
    checkpoint: str,
    max_length: int = DEFAULT_MAX_LENGTH,
    keep: tuple[str, ...] = (),
    **options,
) -> StreamingQuery:
    """Chunk every new document and extend the search index at ``path``, as a batch would."""

    def add(batch: DataFrame, _epoch: int) -> None:
        extend_search_index(
            chunk_documents(batch, keep=keep, max_length=max_length), path, **options
        )

    return (
        documents.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
