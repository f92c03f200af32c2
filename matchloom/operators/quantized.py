"""Nearest neighbours over compressed vectors: residual product quantization.

Vectors lie in the folders of K-means cells. What is left of a vector after its cell's
centroid is cut into parts, and each part is stored as one byte: the number of the nearest
entry of that part's codebook. A query asks with lookup tables: its product with every
centroid and with every entry is worked out once, and a stored row costs one addition per
byte. The best rows by these sums are re-ranked by their exact products, so scores are those
of the exact search, and only full vectors of a short list are read.

Codebooks are learned in Spark by rounds of assignment that send sums per entry. How many
cells to probe and how long a list to re-rank follow from a recall goal, measured with
stored vectors as queries.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators import ann
from matchloom.operators.scale import BROADCAST_ROWS, is_small, lookup_join, top_k_per_group
from matchloom.operators.similarity import _arrow_matrix, _Best, _round_half_up, pa_type, top_k_by_dot
from matchloom.storage import materialize

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS, ENTRIES, ROUNDS = 16, 64, 8
# Stored vectors that serve as queries when probes and list lengths are chosen.
TUNING_QUERIES = 256
# Longest list that tuning tries, in multiples of k.
LONGEST_LIST = 64


class Quantizer(NamedTuple):
    centroids: np.ndarray  # cell, place
    books: np.ndarray  # part, entry, place in the part


class QuantizedIndex(NamedTuple):
    codes: DataFrame  # id, code, cell
    vectors: DataFrame  # id, embedding, cell
    quantizer: Quantizer


class Effort(NamedTuple):
    """Cells to probe and rows to re-rank per query, and the recall they were chosen for."""

    probes: int
    listed: int
    recall: float


def _nearest(parts: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Number of the nearest entry for every (row, part)."""
    codes = np.empty(parts.shape[:2], np.uint8)
    for p in range(parts.shape[1]):
        distance = np.square(books[p]).sum(1) - 2 * (parts[:, p] @ books[p].T)
        codes[:, p] = distance.argmin(1)
    return codes


def _residuals(batch: pa.RecordBatch, quantizer: Quantizer) -> np.ndarray:
    """(row, part, place) of what the cells' centroids leave; batch has embedding and cell."""
    parts, _, width = quantizer.books.shape
    matrix = _arrow_matrix(batch.column("embedding"))
    rest = matrix - quantizer.centroids[batch.column("cell").to_numpy(zero_copy_only=False)]
    padded = np.zeros((len(rest), parts * width))
    padded[:, : rest.shape[1]] = rest
    return padded.reshape(len(rest), parts, width)


def train_quantizer(
    corpus: DataFrame, n_cells: int, *, corpus_id: str = "chunk_id", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, seed: int = 42,
) -> Quantizer:
    """Cells and codebooks of all vectors of ``corpus`` (id, embedding)."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number is one byte")
    centroids = ann.train_cells(corpus, n_cells, seed=seed)
    placed = materialize(
        ann.with_cells(corpus.select(F.col(corpus_id).alias("_id"), F.col("embedding").cast("array<float>").alias("embedding")), centroids)
        .filter("cell IS NOT NULL"),
        "placed",
    )
    width = -(-centroids.shape[1] // parts)
    # The entries start as the residuals of rows drawn by a hash: parts * entries numbers.
    first = placed.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(entries).select("embedding", "cell").toArrow()
    quantizer = Quantizer(centroids, np.zeros((parts, 1, width)))
    drawn = first.combine_chunks().to_batches()
    books = np.concatenate([_residuals(b, quantizer) for b in drawn]).transpose(1, 0, 2)
    n = books.shape[1]
    for _ in range(rounds):
        quantizer = Quantizer(centroids, books)

        def sums(batches: Iterator[pa.RecordBatch], quantizer=quantizer) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(parts * n), np.zeros((parts * n, width))
            for batch in batches:
                rest = _residuals(batch, quantizer)
                entry = _nearest(rest, quantizer.books) + np.arange(parts) * n
                count += np.bincount(entry.ravel(), minlength=parts * n)
                for w in range(width):
                    total[:, w] += np.bincount(entry.ravel(), rest[:, :, w].ravel(), parts * n)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict(
                {"entry": pa.array(used, pa.int32()), "n": count[used]} | {f"s{w}": total[used, w] for w in range(width)}
            )

        names = ["n"] + [f"s{w}" for w in range(width)]
        found = (
            placed.select("embedding", "cell")
            .mapInArrow(sums, "entry int, " + ", ".join(f"{c} double" for c in names))
            .groupBy("entry").agg(*[F.sum(c).alias(c) for c in names]).collect()
        )  # at most parts * entries rows
        books = books.copy().reshape(parts * n, width)
        for row in found:
            books[row["entry"]] = [row[f"s{w}"] / row["n"] for w in range(width)]
        books = books.reshape(parts, n, width)
    return Quantizer(centroids, books)


def write_index(corpus: DataFrame, quantizer: Quantizer, path: str, *, corpus_id: str = "chunk_id") -> None:
    """Codes and vectors in a folder per cell; every row with a vector is in both."""
    vectors = corpus.select(corpus_id, F.col("embedding").cast("array<float>").alias("embedding"))
    ann.write_cells(vectors, quantizer.centroids, f"{path}/vectors", id_col=corpus_id)
    stored = corpus.sparkSession.read.parquet(f"{path}/vectors")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _nearest(_residuals(batch, quantizer), quantizer.books)
            yield pa.RecordBatch.from_arrays(
                [batch.column(corpus_id), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("cell")],
                names=[corpus_id, "code", "cell"],
            )

    schema = T.StructType([stored.schema[corpus_id], T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType())])
    coded = stored.select(corpus_id, "embedding", "cell").mapInArrow(code, schema)
    coded.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")


def read_index(spark: SparkSession, path: str, quantizer: Quantizer) -> QuantizedIndex:
    return QuantizedIndex(spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"), quantizer)


def list_candidates(
    queries: DataFrame, index: QuantizedIndex, listed: int, probes: int, *, query_id: str = "query_id",
    query_vec: str = "embedding", corpus_id: str = "chunk_id",
) -> DataFrame:
    """(query_id, id, cell, score, rank): the ``listed`` rows of each query by their codes."""
    quantizer = index.quantizer
    parts, entries, width = quantizer.books.shape
    codes = index.codes
    schema = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType), codes.schema[corpus_id],
        T.StructField("score", T.DoubleType()),
    ])
    kinds = [pa_type(f.dataType) for f in schema[:2]] + [pa.float64()]
    found = []
    for ids, matrix in ann._parts(queries, query_id, query_vec):
        near = ann._probed(matrix, quantizer.centroids, min(probes, len(quantizer.centroids)))
        asking = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        padded = np.zeros((len(matrix), parts * width))
        padded[:, : matrix.shape[1]] = matrix
        # Products of every query with every entry and every centroid.
        tables = np.einsum("qpw,pew->qpe", padded.reshape(-1, parts, width), quantizer.books)
        to_cell = matrix @ quantizer.centroids.T

        def scan(batches, ids=ids, tables=tables, to_cell=to_cell, asking=asking):
            best = _Best(len(ids), listed)
            flat = tables.reshape(len(ids), parts * entries)
            for batch in batches:
                cell = batch.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cell):
                    rows = batch.filter(pa.array(cell == c))
                    own = asking[int(c)]
                    for lo in range(0, rows.num_rows, 4096):
                        some = rows.slice(lo, 4096)
                        code = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                        at = code + np.arange(parts) * entries
                        scores = to_cell[own, c][None, :] + sum(flat[own][:, at[:, p]] for p in range(parts)).T
                        names = np.array(some.column(0).to_pylist(), dtype=object)
                        best.add(names, _round_half_up(scores), own)
            rows = best.rows(ids, query_id, corpus_id)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))

        rows = codes.filter(F.col("cell").isin(list(asking))).select(corpus_id, "code", "cell")
        found.append(rows.mapInArrow(scan, schema))
    if not found:
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    order = [F.col("score").desc(), F.col(corpus_id).asc()]
    return top_k_per_group(reduce(DataFrame.unionByName, found), [query_id], order, listed, salt_by=[corpus_id])


def top_k(
    queries: DataFrame, index: QuantizedIndex, k: int, effort: Effort, *, query_id: str = "query_id",
    query_vec: str = "embedding", corpus_id: str = "chunk_id",
) -> DataFrame:
    """(query_id, id, score, rank): exact scores of the best ``k`` rows of the short lists."""
    names = {"query_id": query_id, "query_vec": query_vec, "corpus_id": corpus_id}
    listed = materialize(
        list_candidates(queries, index, max(k, effort.listed), effort.probes, **names).select(query_id, corpus_id), "listed"
    )
    # The lists are queries * listed rows; full vectors of no others are kept.
    bounded = is_small(listed, BROADCAST_ROWS)
    asked = queries.select(query_id, F.col(query_vec).cast("array<float>").alias("_query"))
    pairs = lookup_join(
        index.vectors.select(corpus_id, F.col("embedding").alias("_row")), listed, [corpus_id], small_is_bounded=bounded
    ).join(F.broadcast(asked) if is_small(asked, BROADCAST_ROWS // 10) else asked, query_id)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = _arrow_matrix(batch.column("_row")), _arrow_matrix(batch.column("_query"))
                score = _round_half_up(np.einsum("ij,ij->i", a, b))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(query_id), batch.column(corpus_id), pa.array(score)], names=[query_id, corpus_id, "score"]
                )

    schema = T.StructType([pairs.schema[query_id], pairs.schema[corpus_id], T.StructField("score", T.DoubleType())])
    scored = pairs.select(query_id, corpus_id, "_row", "_query").mapInArrow(exact, schema)
    return top_k_per_group(scored, [query_id], [F.col("score").desc(), F.col(corpus_id).asc()], k, salt_by=[corpus_id])


def choose_effort(
    index: QuantizedIndex, k: int, goal: float, *, corpus_id: str = "chunk_id", sample: int = TUNING_QUERIES
) -> Effort:
    """The least probes and the shortest lists that reach ``goal`` on stored vectors.

    At most ``sample`` stored rows, drawn by a hash of their ids, ask for their exact ``k``
    best. Probes follow from the cells of what they should find, list lengths from its
    ranks by codes; each gets half of the loss that the goal allows.
    """
    stored = index.vectors.select(F.col(corpus_id).alias("query_id"), "embedding")
    queries = materialize(stored.orderBy(F.xxhash64("query_id", F.lit(7)), "query_id").limit(sample), "tuning")
    exact = materialize(top_k_by_dot(queries, index.vectors, k, corpus_id=corpus_id), "tuning-exact")
    wanted = (1 + goal) / 2
    cells = index.codes.select(corpus_id, "cell")
    hits = lookup_join(cells, exact.select("query_id", corpus_id), [corpus_id], small_is_bounded=True).toArrow()
    ids, matrix = next(ann._parts(queries, "query_id", "embedding"))
    order = ann._probed(matrix, index.quantizer.centroids, len(index.quantizer.centroids))
    row = {q: i for i, q in enumerate(ids.tolist())}
    place = np.sort([
        int(np.flatnonzero(order[row[q]] == c)[0]) for q, c in zip(hits["query_id"].to_pylist(), hits["cell"].to_pylist())
    ])  # at most sample * k
    probes = int(place[min(len(place) - 1, int(np.ceil(wanted * len(place))) - 1)]) + 1
    longest = LONGEST_LIST * k
    ranked = list_candidates(queries, index, longest, probes, corpus_id=corpus_id)
    ranks = exact.select("query_id", corpus_id).join(
        ranked.select("query_id", corpus_id, F.col("rank").alias("_rank")), ["query_id", corpus_id], "left"
    )
    found = np.sort([r["_rank"] or longest + 1 for r in ranks.select("_rank").collect()])
    at = min(len(found) - 1, int(np.ceil(goal * len(found))) - 1)
    listed = min(longest, int(found[at]))
    return Effort(probes, max(k, listed), float((found <= listed).mean()))
