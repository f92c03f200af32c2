"""Embedding of text columns with a pluggable model.

``embedder`` is a function without arguments that loads a model and returns
``encode(list_of_texts) -> 2-d float array``. It is called once per task, the
texts arrive in Arrow batches, and a lost task is simply run again. Without an
embedder the JVM-side feature hashing of
:func:`matchloom.functions.vectors.hash_embedding` is used.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import normalize_key
from matchloom.functions.vectors import DEFAULT_DIM, hash_embedding
from matchloom.operators.quality import Split

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Encode = Callable[[list[str]], np.ndarray]
Embedder = Callable[[], Encode]


def embed_input(text: Column | str, metadata: Column | None = None) -> Column:
    """What the model sees: metadata lines in key order, a blank line, the text."""
    body = F.col(text) if isinstance(text, str) else text
    if metadata is None:
        return body
    lines = F.transform(
        F.array_sort(F.map_keys(metadata)),
        lambda k: F.concat(k, F.lit(": "), F.coalesce(metadata[k], F.lit(""))),
    )
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), body)


# Errors that concern one text and not the model. Anything else fails the job.
TOLERATED: tuple[type[BaseException], ...] = (MemoryError,)


def _model_column(
    text: Column, embedder: Embedder, batch_size: int, tolerate: tuple[type[BaseException], ...]
) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = embedder()
        for batch in batches:
            texts = batch.to_pylist()
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            for lo in range(0, len(texts), batch_size):
                part = range(lo, min(lo + batch_size, len(texts)))
                _encode_rows(encode, texts, part, vectors, errors, tolerate)
            yield pa.StructArray.from_arrays(
                [pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())],
                names=["embedding", "error"],
            )

    # Not deterministic for the optimizer: a filter on the result would otherwise be
    # pushed below it, and the model would run twice.
    model = F.arrow_udf(run, "struct<embedding:array<float>,error:string>")
    return model.asNondeterministic()(text)


def _encode_rows(
    encode: Encode, texts, part: range, vectors: list, errors: list, tolerate
) -> None:
    """Encode a batch; if a tolerated error comes, row by row, so that a bad row stays alone."""
    try:
        rows = np.asarray(encode([texts[i] for i in part]), dtype=np.float32)
        for i, row in zip(part, rows, strict=True):
            vectors[i] = row
    except tolerate as error:
        if len(part) == 1:
            vectors[part[0]], errors[part[0]] = None, f"{type(error).__name__}: {error}"
            return
        for i in part:
            _encode_rows(encode, texts, range(i, i + 1), vectors, errors, tolerate)


def embed_column(
    df: DataFrame,
    text: Column | str,
    *,
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIM,
    partitions: int | None = None,
    spread_by: Sequence[str] = (),
    batch_size: int = 32,
    tolerate: tuple[type[BaseException], ...] = TOLERATED,
) -> DataFrame:
    """Adds ``embedding ARRAY<FLOAT>`` and ``error STRING``.

    A text on which the model raises one of ``tolerate`` has no vector and the reason in
    ``error``; any other exception fails the job.

    ``partitions`` with ``spread_by`` (a unique key) deals the rows out evenly
    before a costly model runs; hashing by key keeps a re-run task's rows the same.
    """
    body = F.col(text) if isinstance(text, str) else text
    if partitions:
        df = df.repartition(partitions, *spread_by)
    if embedder is None:
        return df.withColumn("embedding", hash_embedding(body, dim)).withColumn(
            "error", F.when(body.isNull(), F.lit("no text"))
        )
    return (
        df.withColumn("_out", _model_column(body, embedder, batch_size, tolerate))
        .withColumn("embedding", F.col("_out.embedding"))
        .withColumn("error", F.col("_out.error"))
        .drop("_out")
    )


def split_embedded(df: DataFrame) -> Split:
    """Embedded rows, and the quarantine with the reason in ``error``."""
    bad = F.col("error").isNotNull()
    return Split(df.filter(~bad).drop("error"), df.filter(bad).drop("embedding"))


def embed_distinct(
    df: DataFrame,
    text: str,
    *,
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIM,
    key: str = "key",
    tolerate: tuple[type[BaseException], ...] = TOLERATED,
) -> DataFrame:
    """(key, n, embedding, error): every distinct normalised non-blank string once.

    ``n`` counts its rows.
    """
    keys = distinct_keys(df, text, key)
    return embed_column(keys, key, embedder=embedder, dim=dim, tolerate=tolerate)


def distinct_keys(df: DataFrame, text: str, key: str = "key") -> DataFrame:
    """(key, n): distinct normalised non-blank strings and their numbers of rows.

    Duplicates collapse in the map tasks, so a string that makes up most rows costs no
    more than any other.
    """
    keys = df.select(normalize_key(text).alias(key)).filter(F.col(key) != "")
    return keys.groupBy(key).agg(F.count("*").alias("n"))
