"""Vector codes by exact integer arithmetic: product codebooks learned in Spark.

Components become integers, vectors are cut into equal parts, and each part is coded as the
index of the nearest entry of that part's codebook. Nearest entries are found in the
Walsh-Hadamard domain: parts and entries are padded with zeros to a power of two and
transformed, which multiplies squared distances by that power. Squared differences are added
up coefficient by coefficient in sequency order, where the energy comes first; an entry goes
as soon as its sum exceeds the whole distance of another entry. All numbers are 64-bit
integers, so the result does not depend on the order of rows, tasks or sums.

Codebooks are refined by rounds of assignment. A round is one pass of the vectors through
tasks that return a count and sums per (part, entry), at most parts * entries rows a task.

Defined cases: rows whose vector is null, empty or holds a null or non-finite component
take no part; a null id counts, after all others; among rows of one id the smallest vector
is the one a codebook starts with; integers saturate at 2**25, beyond which squares would
leave 64 bits; a vector shorter than the longest, or a longest one that the parts do not
divide, is continued with zeros; with fewer ids than entries the codebooks are that much
smaller; a table without a vector that takes part gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.scale import is_small, lookup_join
from matchloom.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
SATURATION = 1 << 25
# Coefficients compared for all entries before any is eliminated.
DENSE = 2
# Labels of which the sums are sent to every task.
BROADCAST_LABELS = 100_000


def sequency(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by their number of sign changes."""
    matrix = np.ones((1, 1), np.int64)
    while len(matrix) < size:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[np.argsort((np.diff(matrix, axis=1) != 0).sum(1))]


def transform(parts: np.ndarray) -> np.ndarray:
    """Coefficients of the last axis, padded with zeros to a power of two."""
    width = parts.shape[-1]
    size = 1 << (width - 1).bit_length()
    return parts @ sequency(size)[:, :width].T


def nearest_entry(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` the nearest row of ``entries``, the first of equals, and
    the squared distance."""
    x, c = transform(parts), transform(entries)
    size = x.shape[1]
    sums = np.zeros((len(x), len(c)), np.int64)
    for k in range(min(DENSE, size)):
        sums += np.square(x[:, k, None] - c[:, k])
    guess = sums.argmin(1)
    bound = np.square(x - c[guess]).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    for k in range(DENSE, size):
        sums = sums + np.square(x[row, k] - c[entry, k])
        alive = sums <= bound[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    # Every row still has its guess; rows ascend, and entries inside a row.
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    least = np.minimum.reduceat(sums, first)
    hit = np.flatnonzero(sums == np.repeat(least, np.diff(np.append(first, len(row)))))
    best = hit[np.searchsorted(hit, first)]
    return entry[best], least // size


def integer_vectors(column: pa.Array, width: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components as integers in ``width`` columns."""
    values = column.flatten().cast(pa.float64())
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    broken = np.bincount(row[~np.isfinite(flat)], minlength=len(column)) > 0
    takes_part = (lengths > 0) & ~broken
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.nan_to_num(np.clip(np.floor(flat * scale), -SATURATION, SATURATION)).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[row, place] = whole
    return takes_part, out[takes_part]


def _assign(batch: pa.RecordBatch, books: np.ndarray):
    """Rows that take part, their parts (rows, parts, width), codes and summed distances."""
    parts, _, width = books.shape
    takes_part, vectors = integer_vectors(batch.column("embedding"), parts * width)
    cut = vectors.reshape(-1, parts, width)
    codes = np.zeros((len(cut), parts), np.int64)
    error = np.zeros(len(cut), np.int64)
    for p in range(parts) if len(cut) else ():
        codes[:, p], distance = nearest_entry(cut[:, p], books[p])
        error += distance
    return takes_part, cut, codes, error


def _first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks (part, entry, place) of the smallest ids; None without vectors."""
    usable = vectors.filter(
        F.expr(
            "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) "
            "and abs(x) < double('infinity'))"
        )
    )
    length = usable.agg(F.max(F.size("embedding"))).first()[0]
    if not length:
        return None
    width = -(-length // parts)
    whole = F.transform(
        "embedding",
        lambda x: F.greatest(
            F.least(F.floor(x.cast("double") * SCALE), F.lit(SATURATION)), F.lit(-SATURATION)
        ).cast("bigint"),
    )
    seeds = (
        usable.groupBy("vec_id").agg(F.min(whole).alias("v"))
        .orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()
    )
    books = np.zeros((parts, len(seeds), width), np.int64)
    for e, row in enumerate(seeds):
        padded = np.zeros(parts * width, np.int64)
        padded[: len(row["v"])] = row["v"]
        books[:, e] = padded.reshape(parts, width)
    return books


def _refine(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts nearest to it."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(parts * entries, np.int64)
        total = np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            _, cut, codes, _ = _assign(batch, books)
            cell = codes + np.arange(parts) * entries
            n += np.bincount(cell.ravel(), minlength=len(n))
            order = np.argsort(cell.ravel(), kind="stable")
            found, first = np.unique(cell.ravel()[order], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(cut.reshape(-1, width)[order], first)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict(
            {"cell": pa.array(used, pa.int32()), "n": n[used]} | {f"s{i}": total[used, i] for i in range(width)}
        )

    names = ["n"] + [f"s{i}" for i in range(width)]
    schema = "cell int, " + ", ".join(f"{c} bigint" for c in names)
    found = (
        vectors.select("embedding").mapInArrow(sums, schema)
        .groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).collect()
    )  # at most parts * entries rows
    out = books.copy().reshape(parts * entries, width)
    for row in found:
        out[row["cell"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out.reshape(books.shape)


def learn_codebooks(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> np.ndarray | None:
    """Codebooks (part, entry, place) for ``embedding`` of all rows; None without vectors."""
    books = _first_books(vectors, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = _refine(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every row that takes part."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            takes_part, _, codes, error = _assign(batch, books)
            kept = pa.array(takes_part)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").filter(kept),
                    batch.column("label").filter(kept),
                    pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string()),
                    pa.array(error),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(
        code, f"vec_id bigint, label {label}, code string, error bigint"
    )


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with ``approximation``, the integer vector that its code stands for."""
    parts = range(books.shape[0])
    table = F.array(*[F.array(*[F.array(*map(F.lit, e.tolist())) for e in books[p]]) for p in parts])
    index = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in parts]
    return coded.withColumn("approximation", F.concat(*[table[p][index[p]] for p in parts]))


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of the components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that takes part."""
    vectors = vectors.withColumn("vec_id", F.col("vec_id").cast("bigint"))
    books = learn_codebooks(vectors)
    if books is None:
        schema = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    # A null label is a label of its own.
    key = F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")
    coded = materialize(
        encode(vectors, books).select("vec_id", "code", "error", F.col("label").isNull().alias("_no_label"), key),
        "codes",
    )
    on = ["_no_label", "_label"]
    by_label = coded.groupBy(*on).agg(F.sum("error").alias("label_error"))
    return lookup_join(
        coded, by_label, on, small_is_bounded=is_small(by_label, BROADCAST_LABELS)
    ).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, width: int = 8) -> str:
    """The same in DuckDB's SQL for vectors of ``parts * width`` components."""
    steps = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 parts AS (
  SELECT r, p, list_slice(v, {width} * p + 1, {width} * p + {width}) AS x
  FROM kept, range({parts}) AS t(p)),
 seeds AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, v
  FROM (SELECT vec_id, min(v) AS v FROM kept GROUP BY vec_id) ORDER BY vec_id LIMIT {entries}),
 b0 AS (
  SELECT p, e, list_slice(v, {width} * p + 1, {width} * p + {width}) AS c
  FROM seeds, range({parts}) AS t(p))"""
    ]
    for i in range(rounds + 1):
        distance = " + ".join(f"(x[{k}] - c[{k}]) * (x[{k}] - c[{k}])" for k in range(1, width + 1))
        steps.append(
            f"""a{i} AS (
  SELECT r, p, x, CAST(best.d AS BIGINT) AS d, CAST(best.e AS BIGINT) AS e FROM (
   SELECT r, p, any_value(x) AS x, min({{'d': {distance}, 'e': e}}) AS best
   FROM parts JOIN b{i} USING (p) GROUP BY r, p))"""
        )
        if i < rounds:
            means = ", ".join(
                f"CAST((sum(x[{k}]) - ((sum(x[{k}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
                for k in range(1, width + 1)
            )
            steps.append(
                f"""b{i + 1} AS (
  SELECT b{i}.p, b{i}.e, coalesce(m.c, b{i}.c) AS c FROM b{i} LEFT JOIN (
   SELECT p, e, [{means}] AS c FROM a{i} GROUP BY p, e) m ON m.p = b{i}.p AND m.e = b{i}.e)"""
            )
    return f"""WITH {", ".join(steps)},
 digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
 coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r) CROSS JOIN digest"""
