"""All-against-all similarity of two vector tables without a cross join.

Both operators multiply blocks of vectors inside tasks and emit only what the
result needs: pairs at or above a threshold, or the best ``k`` per query.

Two ways to bring the sides together, chosen by counting the smaller side:

* up to ``BLOCK_ROWS`` vectors: the block travels with the function and the other
  table streams past it in Arrow batches, without any shuffle;
* beyond: the grid of Okcan & Riedewald (2011). Each side is cut into hash blocks,
  copied to the row or column of cells it belongs to, and every cell multiplies
  one block by one block. Cells are of bounded size whatever the data looks like. With a
  threshold the blocks follow pivots: pieces of rows around a pivot have a bound of their
  products, and only pieces whose bound reaches the threshold meet.

Vector tables have a unique ``id`` column and a vector column of one length.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.vectors import VECTOR_DIGITS
from matchloom.operators.filters import RequestFilters
from matchloom.operators.scale import top_k_per_group
from matchloom.storage import materialize

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors in one block; at 2560 float components a block is about 40 MB.
BLOCK_ROWS = 4096
# Scores worked on at once in a task (doubles, so 32 MB).
SCORES_AT_ONCE = 4_000_000
# The most pivots around which rows are gathered; their pairs are broadcast.
MAX_PIVOTS = 256


def _round_half_up(x: np.ndarray) -> np.ndarray:
    scale = 10.0**VECTOR_DIGITS
    return np.sign(x) * np.floor(np.abs(x) * scale + 0.5) / scale


def _arrow_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _threshold_pairs(a: np.ndarray, b: np.ndarray, threshold: float):
    """Row numbers (i of ``a``, j of ``b``) and scores of the pairs to keep."""
    step = max(1, SCORES_AT_ONCE // max(1, len(b)))
    for lo in range(0, len(a), step):
        scores = _round_half_up(a[lo : lo + step] @ b.T)
        i, j = np.nonzero(scores >= threshold)
        if len(i):
            yield i + lo, j, scores[i, j]


@dataclass
class _Best:
    """Running best ``k`` rows per query: score first, then the smaller id."""

    queries: int
    k: int

    def __post_init__(self) -> None:
        self.ids: list[np.ndarray] = [np.empty(0, object) for _ in range(self.queries)]
        self.scores: list[np.ndarray] = [np.empty(0) for _ in range(self.queries)]

    def add(self, ids: np.ndarray, scores: np.ndarray, queries: np.ndarray | None = None) -> None:
        """``scores`` is (rows, queries), of all queries or of those named; a row that a
        query must not have scores minus infinity."""
        for n, q in enumerate(range(self.queries) if queries is None else queries):
            column = scores[:, n]
            if len(self.scores[q]) >= self.k:
                keep = column >= self.scores[q][-1]
            else:
                keep = column != -np.inf
            if len(column) > self.k:
                # Ties at the k-th score are all kept here; the order decides below.
                edge = np.partition(column, len(column) - self.k)[len(column) - self.k]
                keep &= column >= edge
            if not keep.any():
                continue
            all_ids = np.concatenate([self.ids[q], ids[keep]])
            all_scores = np.concatenate([self.scores[q], column[keep]])
            order = sorted(range(len(all_ids)), key=lambda i: (-all_scores[i], all_ids[i]))
            order = order[: self.k]
            self.ids[q], self.scores[q] = all_ids[order], all_scores[order]

    def rows(self, ids: np.ndarray, query_id: str, corpus_id: str) -> dict[str, list]:
        out: dict[str, list] = {query_id: [], corpus_id: [], "score": []}
        for n in range(self.queries):
            out[query_id].extend([ids[n]] * len(self.ids[n]))
            out[corpus_id].extend(self.ids[n])
            out["score"].extend(self.scores[n])
        return out


def _as_vectors(
    df: DataFrame, id_col: str, vec_col: str, id_as: str, vec_as: str, others: list | None = None
) -> DataFrame:
    """Rows without a vector are dropped by the kernels: a filter here would be pushed
    below the embedding expression and work it out a second time."""
    vec = F.col(vec_col).cast("array<float>")
    return df.select(F.col(id_col).alias(id_as), vec.alias(vec_as), *(others or []))


def _with_vector(rows):
    """Arrow rows whose second column is present."""
    return rows.filter(pc.is_valid(rows.column(1)))


def _block(df: DataFrame) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Ids, vectors and rows of a table known to hold at most ``BLOCK_ROWS`` rows."""
    rows = _with_vector(df.toArrow()).combine_chunks()
    ids = np.array(rows.column(0).to_pylist(), dtype=object)
    if not len(ids):
        return ids, np.empty((0, 0)), rows
    column = rows.column(1)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return ids, _arrow_matrix(column), rows


def _grid(left: DataFrame, right: DataFrame, n_left: int, n_right: int):
    """Both sides copied to the cells (left block, right block) they meet in."""
    rows = max(1, -(-n_left // BLOCK_ROWS))
    cols = max(1, -(-n_right // BLOCK_ROWS))

    def own(df: DataFrame, name: str, n: int) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int"))

    def every(name: str, n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    a = own(left, "_r", rows).select("*", every("_c", cols))
    b = own(right, "_c", cols).select("*", every("_r", rows))
    return a.groupBy("_r", "_c"), b.groupBy("_r", "_c")


def _around(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with an id and a vector, their nearest pivot ``_cell`` and the distance to it."""
    square = (pivots**2).sum(1)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_with_vector, batches):
            batch = batch.filter(pc.is_valid(batch.column(0)))
            if not batch.num_rows:
                continue
            v = _arrow_matrix(batch.column(1))
            cell = (square - 2 * v @ pivots.T).argmin(1)
            away = np.linalg.norm(v - pivots[cell], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(away)],
                names=[*batch.schema.names, "_cell", "_away"],
            )

    return df.mapInArrow(assign, f"{fields}, _cell int, _away double")


def near_cells(
    pivots: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float
) -> np.ndarray:
    """(left cell, right cell) that may hold a pair of at least ``threshold``.

    ``left`` and ``right`` are the cells' radii, minus one for an empty cell. Rows p + x and
    q + y with |x| <= r and |y| <= s have a product of at most pq + r|q| + s|p| + rs.
    """
    size = np.linalg.norm(pivots, axis=1)
    most = pivots @ pivots.T + left[:, None] * size + right * size[:, None] + left[:, None] * right
    # Rounding of scores and of the bound itself.
    slack = 10.0**-VECTOR_DIGITS + 1e-9 * (1 + np.abs(most))
    return np.argwhere((most >= threshold - slack) & (left >= 0)[:, None] & (right >= 0))


def _near_grid(left: DataFrame, right: DataFrame, n: int, threshold: float, block_rows: int):
    """Both sides copied to the cells (left piece, right piece) that may hold a pair.

    The pivots are the rows with the smallest hashes of their ids on the left: a bounded
    number, as many as make pieces of about half a block. A pivot that very many rows
    are near to has several pieces.
    """
    spark = left.sparkSession
    wanted = min(MAX_PIVOTS, max(2, 2 * -(-n // block_rows)))
    sample = left.filter(F.col("_va").isNotNull()).orderBy(F.xxhash64("_a"), "_a").limit(wanted)
    pivots = np.array([r["_va"] for r in sample.collect()], dtype=np.float64)
    if not len(pivots):
        pivots = np.zeros((1, 1))
        left, right = left.limit(0), right.limit(0)
    sides, radii, pieces = [], [], []
    for df in (left, right):
        df = _around(df, pivots)
        radius, count = np.full(len(pivots), -1.0), np.zeros(len(pivots), int)
        # One row per pivot.
        for r in df.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_away").alias("r")).collect():
            radius[r["_cell"]], count[r["_cell"]] = r["r"], -(-r["n"] // block_rows)
        sides.append(df), radii.append(radius), pieces.append(count)
    near = near_cells(pivots, *radii, threshold).tolist()
    grouped = []
    for side, (own, other) in enumerate((("_r", "_c"), ("_c", "_r"))):
        begin = [np.concatenate([[0], np.cumsum(p)]) for p in pieces]
        rows = [
            (pair[side], int(begin[side][pair[side]]), int(pieces[side][pair[side]]),
             int(begin[1 - side][pair[1 - side]]), int(pieces[1 - side][pair[1 - side]]))
            for pair in near
        ]
        meets = spark.createDataFrame(rows, "_cell int, _own int, _own_n int, _at int, _n int")
        df = sides[side]
        piece = F.pmod(F.xxhash64(df.columns[0]), F.col("_own_n")).cast("int")
        copied = df.join(F.broadcast(meets), "_cell").select(
            *df.columns[:2],
            (F.col("_own") + piece).alias(own),
            F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_n") - 1)).alias(other),
        )
        grouped.append(copied.groupBy("_r", "_c"))
    return grouped


def pairs_at_least(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    *,
    left_id: str = "left_id",
    right_id: str = "right_id",
    left_vec: str = "embedding",
    right_vec: str = "embedding",
    out_left: str = "left_id",
    out_right: str = "right_id",
    block_rows: int = BLOCK_ROWS,
    right_at_most: int | None = None,
) -> DataFrame:
    """Every pair whose rounded dot product is ``>= threshold``.

    Returns (out_left, out_right, similarity). A caller who knows a bound on the
    rows of ``right`` gives it in ``right_at_most`` and saves a count.
    """
    a = _as_vectors(left, left_id, left_vec, "_a", "_va")
    b = _as_vectors(right, right_id, right_vec, "_b", "_vb")
    schema = T.StructType(
        [
            T.StructField(out_left, a.schema["_a"].dataType),
            T.StructField(out_right, b.schema["_b"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    if right_at_most is None or right_at_most > block_rows:
        right_at_most = b.count()
    if right_at_most <= block_rows:
        ids, matrix, _ = _block(b)
        a_type, b_type = pa_type(a.schema["_a"].dataType), pa_type(b.schema["_b"].dataType)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in map(_with_vector, batches):
                if not len(ids) or not batch.num_rows:
                    continue
                mine = np.array(batch.column(0).to_pylist(), dtype=object)
                for i, j, s in _threshold_pairs(_arrow_matrix(batch.column(1)), matrix, threshold):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mine[i], a_type), pa.array(ids[j], b_type), pa.array(s)],
                        names=[out_left, out_right, "similarity"],
                    )

        return a.mapInArrow(stream, schema)

    # Read several times from here on; vectors may come from a model.
    a, b = materialize(a, "left"), materialize(b, "right")
    cells_a, cells_b = _near_grid(a, b, max(a.count(), right_at_most), threshold, block_rows)

    kinds = [pa_type(a.schema["_a"].dataType), pa_type(b.schema["_b"].dataType), pa.float64()]

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        found = [[pa.array([], kind)] for kind in kinds]
        if x.num_rows and y.num_rows:
            va, vb = (_arrow_matrix(pa.concat_arrays(t.column(1).chunks)) for t in (x, y))
            ids_a, ids_b = (np.array(t.column(0).to_pylist(), dtype=object) for t in (x, y))
            for i, j, s in _threshold_pairs(va, vb, threshold):
                for column, values, kind in zip(found, (ids_a[i], ids_b[j], s), kinds):
                    column.append(pa.array(values, kind))
        merged = [pa.concat_arrays(column) for column in found]
        return pa.table(merged, names=[out_left, out_right, "similarity"])

    return cells_a.cogroup(cells_b).applyInArrow(cell, schema)


def top_k_by_dot(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    query_vec: str = "embedding",
    corpus_id: str = "chunk_id",
    corpus_vec: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    queries_at_most: int | None = None,
    filters: RequestFilters | None = None,
) -> DataFrame:
    """Best ``k`` corpus rows per query by rounded dot product, ties by id.

    Returns (query_id, corpus_id, score, rank). Each task keeps ``k`` rows per
    query, so what is shuffled is ``tasks * queries * k`` small rows and never a
    vector. With ``filters`` a query gets the best rows that its own filter allows.
    """
    q = _as_vectors(queries, query_id, query_vec, "_q", "_vq", filters and filters.asked(queries))
    c = _as_vectors(corpus, corpus_id, corpus_vec, "_c_id", "_vc", filters and filters.looked_at())
    schema = T.StructType(
        [
            T.StructField(query_id, q.schema["_q"].dataType),
            T.StructField(corpus_id, c.schema["_c_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    q_type, c_type = pa_type(q.schema["_q"].dataType), pa_type(c.schema["_c_id"].dataType)

    def scored(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        return _round_half_up(vectors @ matrix.T)

    def best_rows(best: _Best, ids: np.ndarray) -> dict[str, list]:
        return best.rows(ids, query_id, corpus_id)

    if queries_at_most is None or queries_at_most > block_rows:
        queries_at_most = q.count()
    if queries_at_most <= block_rows:
        ids, matrix, asked = _block(q)
        own = filters and filters.distinct(asked)

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(ids), k)
            step = max(1, SCORES_AT_ONCE // max(1, len(ids)))
            for batch in map(_with_vector, batches):
                for lo in range(0, batch.num_rows if len(ids) else 0, step):
                    part = batch.slice(lo, step)
                    mine = np.array(part.column(0).to_pylist(), dtype=object)
                    scores = scored(_arrow_matrix(part.column(1)), matrix)
                    if own is not None:
                        scores[~own.allowed(part)] = -np.inf
                    best.add(mine, scores)
            rows = best_rows(best, ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows[query_id], q_type),
                    pa.array(rows[corpus_id], c_type),
                    pa.array(rows["score"], pa.float64()),
                ],
                names=[query_id, corpus_id, "score"],
            )

        partial = c.mapInArrow(stream, schema)
    else:
        cells_c, cells_q = _grid(c, q, c.count(), queries_at_most)

        def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            x, y = x.dropna(subset=["_c_id", "_vc"]), y.dropna(subset=["_q", "_vq"])
            best = _Best(len(y), k)
            if filters is not None:
                own = filters.distinct(filters.from_pandas(y, "_ask_"))
            if len(x) and len(y):
                vectors = np.stack(x["_vc"].to_numpy()).astype(np.float64)
                matrix = np.stack(y["_vq"].to_numpy()).astype(np.float64)
                step = max(1, SCORES_AT_ONCE // len(y))
                for lo in range(0, len(x), step):
                    part = slice(lo, lo + step)
                    mine = x["_c_id"].to_numpy(dtype=object)[part]
                    scores = scored(vectors[part], matrix)
                    if filters is not None:
                        scores[~own.allowed(filters.from_pandas(x[part], "_of_"))] = -np.inf
                    best.add(mine, scores)
            return pd.DataFrame(best_rows(best, y["_q"].to_numpy(dtype=object)))

        partial = cells_c.cogroup(cells_q).applyInPandas(cell, schema)

    order = [F.col("score").desc(), F.col(corpus_id).asc()]
    return top_k_per_group(partial, [query_id], order, k, salt_by=[corpus_id])


def pa_type(dt: T.DataType) -> pa.DataType:
    """Arrow type of an id column."""
    known = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return known[dt.simpleString()]
