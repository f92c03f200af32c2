"""Exact top-k by inner product as a Voronoi join.

Pivots cut queries and data into cells. Summaries of the cells (count, radius) give every
group of queries a score that at least ``k`` rows reach for any query of the group. A row
goes to a group only if its score with some query of the group could reach that bound;
parts of a group's rows are solved locally and their best ``k`` merged.

With ``q = c + d``, ``|d| <= r``, a row v scores between ``c.v - r|v|`` and ``c.v + r|v|``.

Defined cases: vectors that are null, or hold null or non-finite components, and rows
without an id take no part; shorter vectors end in zeros; a row is no candidate for
queries of its own id; rows repeated among the candidates each count, equal query rows
are one query; ties go to the smaller id; fewer than ``k`` candidates give them all.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIVOTS = 64
# Queries that are solved together, and rows that one task holds against them.
GROUP_QUERIES = 4096
PART_ROWS = 20_000
MIN_PARTS = 64
CHUNK = 4096


def whole_numbers(vectors: DataFrame, id_col: str, column: str, scale: float) -> DataFrame:
    """id and vector, each component floor(scale * x), without rows that take no part."""
    x = F.col(column)
    fit = x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    return vectors.filter(F.col(id_col).isNotNull() & fit).select(
        F.col(id_col).cast("bigint").alias("id"), scaled.alias("vector")
    )


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    out = np.zeros((len(column), dim), np.int64)
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(offsets[0], offsets[-1])
    out[row, place - np.repeat(offsets[:-1], sizes)] = values[place]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def _cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with the nearest pivot and the distance to it."""
    dim, square = pivots.shape[1], (pivots.astype(float) ** 2).sum(1)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("vector"), dim).astype(float)
            distance = (v**2).sum(1)[:, None] - 2 * v @ pivots.T.astype(float) + square
            cell = distance.argmin(1)
            away = np.sqrt(np.maximum(distance[np.arange(len(v)), cell], 0)) + 1e-6
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(away)],
                names=[*batch.schema.names, "cell", "away"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(assign, f"{fields}, cell int, away double")


def _summary(rows: DataFrame) -> pd.DataFrame:
    """Count and radius of every cell; as many rows as there are pivots at most."""
    return rows.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("away").alias("radius")
    ).toPandas()


def _own_rows(asking: DataFrame) -> tuple[dict, int]:
    """The most rows that one query id has in each cell, and in all cells together."""
    counts = asking.groupBy("id", "cell").agg(F.count("*").alias("n"))
    found = counts.groupBy("cell").agg(F.max("n").alias("n")).collect()
    total = asking.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return {r["cell"]: r["n"] for r in found}, total or 0


def _query_groups(summary: pd.DataFrame, pivots: np.ndarray, most: int):
    """Cells in neighbouring order gathered to groups of about ``most`` queries.

    Returns cell -> (first group, number of groups) and each group's center and radius.
    """
    order = summary.iloc[np.argsort(pivots[summary["cell"]].astype(float) @ pivots[0], kind="stable")]
    gathered, current, size = [], [], 0
    for row in order.itertuples():
        if current and size + row.n > most:
            gathered.append(current)
            current, size = [], 0
        current.append(row)
        size += row.n
    gathered += [current] if current else []
    where, centers, radii = {}, [], []
    for rows in gathered:
        own = pivots[[r.cell for r in rows]].astype(float)
        center = own.mean(0)
        radius = max(np.linalg.norm(p - center) + r.radius for p, r in zip(own, rows))
        pieces = -(-sum(r.n for r in rows) // most)  # a cell of very many queries
        for r in rows:
            where[r.cell] = (len(centers), pieces)
        centers += [center] * pieces
        radii += [radius] * pieces
    return where, np.array(centers), np.array(radii)


def _bounds(summary: pd.DataFrame, pivots, centers, radii, k: int, own: dict, most_own: int) -> np.ndarray:
    """For each group a score that ``k`` other rows reach with any of its queries.

    Rows of a query's id are no candidates for it, and an id can hold any number of rows.
    Of the rows of some cells, others than those of one id are at least all but
    ``most_own``, and at least what ``own`` leaves of each cell; the larger counts.
    """
    p, n, r = pivots[summary["cell"]].astype(float), summary["n"].to_numpy(), summary["radius"].to_numpy()
    left = n - np.array([own.get(c, 0) for c in summary["cell"]])
    out = []
    for c, s in zip(centers, radii):
        low = p @ c - s * np.linalg.norm(p, axis=1) - r * np.linalg.norm(c) - s * r
        best = np.argsort(-low)
        others = np.maximum(np.cumsum(n[best]) - most_own, np.cumsum(left[best]))
        enough = np.searchsorted(others, k)
        out.append(low[best][enough] if enough < len(best) else -np.inf)
    return np.array(out)


def _solve(queries: pa.Table, rows: pa.Table, dim: int, k: int) -> pa.Table:
    """The best ``k`` of ``rows`` for each query."""
    rows = rows.sort_by("id")
    q, names = _matrix(queries["vector"], dim), queries["id"].to_numpy()
    ids = rows["id"].to_numpy()
    v = _matrix(rows["vector"], dim)
    found = []
    for a in range(0, len(v), CHUNK):
        score = _products(q, v[a : a + CHUNK])
        own = np.searchsorted(ids[a : a + CHUNK], names), np.searchsorted(ids[a : a + CHUNK], names, "right")
        masked = np.zeros(score.shape, bool)
        for i in np.flatnonzero(own[0] < own[1]):
            masked[i, own[0][i] : own[1][i]] = True
        score[masked] = np.iinfo(np.int64).min
        if score.shape[1] > k:
            least = np.partition(score, -k, axis=1)[:, -k]
        else:
            least = np.full(len(q), np.iinfo(np.int64).min)
        i, j = np.nonzero((score >= least[:, None]) & ~masked)
        found.append((i, ids[a + j], score[i, j]))
    i, j, s = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((j, -s, i))
    i, j, s = i[order], j[order], s[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    i, j, s = (x[place < k] for x in (i, j, s))
    return pa.table(
        {"query_id": names[i], "query_key": queries["key"].to_numpy()[i], "vec_id": j, "score": s}
    )


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    *,
    id_col: str = "vec_id",
    column: str = "embedding",
    scale: float = 1024.0,
    pivots: int = PIVOTS,
    group_queries: int = GROUP_QUERIES,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best rows.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, query_key bigint, vec_id bigint, score bigint"
    result = "query_id bigint, rank int, vec_id bigint, score bigint"
    rows = whole_numbers(vectors, id_col, column, scale)
    dim = rows.agg(F.max(F.size("vector"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], result)
    dim = max(1, dim)
    # A bounded set of rows, the same at every run.
    chosen = rows.select("vector").orderBy(F.xxhash64("id", "vector"), "id").limit(pivots)
    centers = np.zeros((0, dim), np.int64)
    for r in chosen.collect():
        centers = np.vstack([centers, np.array(r["vector"] + [0] * (dim - len(r["vector"])), np.int64)])
    celled = materialize(_cells(rows, centers), "knn-cells")
    asking = celled.filter(is_query)
    queries = asking.dropDuplicates(["id", "vector"])
    summary, asked = _summary(celled), _summary(queries)
    if asked.empty:
        return spark.createDataFrame([], result)
    where, group_centers, radii = _query_groups(asked, centers, group_queries)
    bounds = _bounds(summary, centers, group_centers, radii, k, *_own_rows(asking))
    parts = max(MIN_PARTS, -(-int(summary["n"].sum()) // part_rows))

    def replicate(batches):
        slack = 1e-6 * (1.0 + np.abs(np.where(np.isfinite(bounds), bounds, 0)))
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("vector"), dim).astype(float)
            best = v @ group_centers.T + radii * np.linalg.norm(v, axis=1)[:, None]
            i, g = np.nonzero(best >= bounds - slack)
            taken = batch.select(["id", "vector", "part"]).take(pa.array(i))
            for a in range(0, len(i), 8192):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[a : a + 8192], pa.int32()), *taken.slice(a, 8192).columns],
                    names=["grp", "id", "vector", "part"],
                )

    part = F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int")
    data = celled.select("id", "vector", part.alias("part")).mapInArrow(
        replicate, "grp int, id bigint, vector array<bigint>, part int"
    )
    first = spark.createDataFrame(
        [(int(c), int(g), int(n)) for c, (g, n) in where.items()], "cell int, first int, pieces int"
    )
    key = F.xxhash64("vector")
    placed = queries.join(F.broadcast(first), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("id", "vector"), "pieces")).cast("int").alias("grp"),
        "id", "vector", key.alias("key"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )

    def solve(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            kinds = [pa.int64()] * 4
            return pa.table([pa.array([], t) for t in kinds], names=["query_id", "query_key", "vec_id", "score"])
        return _solve(queries, rows, dim, k)

    local = data.groupBy("grp", "part").cogroup(placed.groupBy("grp", "part")).applyInArrow(solve, schema)
    order = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        local.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
