"""Approximate nearest neighbours: K-means cells with exact scoring inside.

Cells decide which rows a query is compared with; the scores and the ranking are
those of the exact search. Vectors are stored in a folder per cell, in files of bounded
size, so a search reads the probed folders only, and a cell holding a third of the
corpus is worked on by a third of the tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.vectors import l2_normalize
from matchloom.operators.scale import top_k_per_group
from matchloom.operators.similarity import (
    BLOCK_ROWS, _arrow_matrix, _as_vectors, _Best, _block, _round_half_up, pa_type,
)
from matchloom.storage import materialize

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors in one file of a cell.
FILE_ROWS = 1_000_000


def train_cells(
    corpus: DataFrame,
    n_cells: int,
    *,
    vec_col: str = "embedding",
    seed: int = 42,
    iterations: int = 10,
) -> np.ndarray:
    """Unit-length centroids of all vectors. They steer the search only."""
    vectors = corpus.filter(F.col(vec_col).isNotNull())
    features = vectors.select(
        array_to_vector(l2_normalize(vec_col).cast("array<double>")).alias("features")
    )
    model = KMeans(k=n_cells, seed=seed, maxIter=iterations).fit(features)
    centroids = np.array(model.clusterCenters())
    return centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)


def with_cells(corpus: DataFrame, centroids: np.ndarray, *, vec_col: str = "embedding") -> DataFrame:
    """``corpus`` with the number of each vector's nearest centroid in ``cell``.

    Rows without a vector have no cell. Ties go to the smaller number.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vec_col))
            valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            cell = np.full(len(column), -1)
            if len(valid):
                scores = _round_half_up(_arrow_matrix(column.take(pa.array(valid))) @ centroids.T)
                cell[valid] = scores.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32(), mask=cell < 0)],
                names=[*batch.schema.names, "cell"],
            )

    schema = T.StructType(corpus.schema.fields + [T.StructField("cell", T.IntegerType())])
    return corpus.mapInArrow(assign, schema)


def write_cells(
    corpus: DataFrame, centroids: np.ndarray, path: str, *, id_col: str = "chunk_id",
    vec_col: str = "embedding", file_rows: int = FILE_ROWS,
) -> None:
    """Store vectors in ``cell=`` folders. A large cell is many files, split by id."""
    placed = materialize(with_cells(corpus, centroids, vec_col=vec_col).filter("cell IS NOT NULL"), "cells")
    files = -(-placed.count() // file_rows) + len(centroids)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / file_rows).alias("_files"))
    part = F.pmod(F.xxhash64(id_col), "_files")
    (
        placed.join(F.broadcast(sizes), "cell").withColumn("_part", part)
        .repartition(files, "cell", "_part").drop("_part", "_files")
        .write.mode("overwrite").partitionBy("cell").parquet(path)
    )


def _probed(matrix: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The nearest centroids of each query, nearest first."""
    scores = _round_half_up(matrix @ centroids.T)
    return np.argsort(-scores, axis=1, kind="stable")[:, :probes]


def _parts(queries: DataFrame, query_id: str, query_vec: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, in parts of a size that travels with a task."""
    vectors = _as_vectors(queries, query_id, query_vec, "_q", "_vq")
    n = -(-vectors.count() // BLOCK_ROWS) * 2 if vectors.count() > BLOCK_ROWS else 1
    for part in range(n):
        own = vectors.filter(F.pmod(F.xxhash64("_q"), F.lit(n)) == part) if n > 1 else vectors
        ids, matrix, _ = _block(own)
        if len(ids):
            yield ids, matrix


def ann_top_k(
    queries: DataFrame, corpus: DataFrame, k: int, centroids: np.ndarray, probes: int, *,
    query_id: str = "query_id", query_vec: str = "embedding", corpus_id: str = "chunk_id",
    corpus_vec: str = "embedding",
) -> DataFrame:
    """Like the exact search, but each query looks into its ``probes`` nearest cells.

    ``corpus`` is a table of :func:`write_cells`, or one without cells, which are then
    worked out. Folders that no query probes are not read; a row is multiplied with the
    queries that probe its cell, and with no others.
    """
    if "cell" not in corpus.columns:
        corpus = with_cells(corpus, centroids, vec_col=corpus_vec)
    schema = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(corpus_id, corpus.schema[corpus_id].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    kinds = [pa_type(f.dataType) for f in schema[:2]] + [pa.float64()]
    found = []
    for ids, matrix in _parts(queries, query_id, query_vec):
        near = _probed(matrix, centroids, min(probes, len(centroids)))
        asking = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}

        def search(batches, ids=ids, matrix=matrix, asking=asking):
            best = _Best(len(ids), k)
            for batch in batches:
                cell = batch.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cell):
                    part = batch.filter(pa.array(cell == c))
                    for lo in range(0, part.num_rows, 4096):
                        rows = part.slice(lo, 4096)
                        names = np.array(rows.column(0).to_pylist(), dtype=object)
                        scores = _round_half_up(_arrow_matrix(rows.column(1)) @ matrix[asking[c]].T)
                        best.add(names, scores, asking[c])
            rows = best.rows(ids, query_id, corpus_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows)
            )

        rows = corpus.filter(F.col("cell").isin(list(asking))).select(
            corpus_id, F.col(corpus_vec).cast("array<float>"), "cell"
        )
        found.append(rows.mapInArrow(search, schema))
    if not found:
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    order = [F.col("score").desc(), F.col(corpus_id).asc()]
    return top_k_per_group(reduce(DataFrame.unionByName, found), [query_id], order, k, salt_by=[corpus_id])


def rows_scored(
    queries: DataFrame, corpus: DataFrame, centroids: np.ndarray, probes: int, *,
    query_id: str = "query_id", query_vec: str = "embedding",
) -> DataFrame:
    """(query_id, rows_scored, rows_all): what each query is compared with in ``corpus``."""
    counts = corpus.filter("cell IS NOT NULL").groupBy("cell").agg(F.count("*").alias("_n"))
    pairs = [
        (q, int(c))
        for ids, matrix in _parts(queries, query_id, query_vec)
        for q, near in zip(ids.tolist(), _probed(matrix, centroids, min(probes, len(centroids))))
        for c in near
    ]
    schema = T.StructType([queries.schema[query_id], T.StructField("cell", T.IntegerType())])
    probed = queries.sparkSession.createDataFrame(pairs, schema)
    everything = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    return (
        probed.join(counts, "cell", "left").groupBy(query_id)
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_scored"))
        .withColumn("rows_all", everything)
    )


def recall(exact: DataFrame, approximate: DataFrame, *, corpus_id: str = "chunk_id") -> DataFrame:
    """(query_id, k, found, recall): share of the exact hits the approximate search has."""
    hits = approximate.select("query_id", corpus_id, F.lit(1).alias("_hit"))
    return (
        exact.join(hits, ["query_id", corpus_id], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("k"), F.count("_hit").alias("found"))
        .withColumn("recall", F.round(F.col("found") / F.col("k"), 4))
    )
