"""BM25 over chunk text (Robertson & Zaragoza, 2009).

The sparse index is three tables: postings (term, chunk, tf, dl), document
frequencies and one row of corpus statistics. A chunk's terms are in one row, so they are
counted where they are; what is shuffled, once, are lists of postings that share a term. A
frequent term may own a third of all postings, so nothing is ever laid out by term alone:
such a term is dealt to several tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from matchloom.functions.text import tokens
from matchloom.functions.vectors import SCORE_DIGITS
from matchloom.operators.filters import DistinctFilters, RequestFilters
from matchloom.operators.scale import top_k_per_group
from matchloom.storage import materialize

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Query terms and queries that travel with a task, and scores a task holds at a time.
TERM_ROWS = 200_000
QUERY_ROWS = 20_000
SCORE_CELLS = 2_000_000
# Postings that a task scores at a time.
POSTING_ROWS = 200_000
# Standard BM25 parameters.
K1 = 1.2
B = 0.75

# Postings per file, and of one term in a task.
FILE_ROWS = 1_000_000
# Words that a task counts at a time.
LIST_WORDS = 4_000_000


# Folders that terms are dealt to; the same in every batch that is added.
TERM_BUCKETS = 64


class LexicalIndex(NamedTuple):
    postings: DataFrame  # term, chunk_id, tf, dl
    frequencies: DataFrame  # term, df (+ term_bucket when written)
    stats: DataFrame  # one row: n_chunks, avg_dl
    forward: DataFrame | None = None  # chunk_id, terms in text order, duplicates kept
    blocks: DataFrame | None = None  # stored postings: batch, term_bucket, term, block, ...
    withdrawn: DataFrame | None = None  # chunk_id, batch of stored postings that no longer count
    lists: DataFrame | None = None  # postings not stored yet: term, chunk_ids, tfs, dls


def build_lexical_index(
    chunks: DataFrame, *, chunk_id: str = "chunk_id", text: str = "text", terms: str | None = None
) -> LexicalIndex:
    """Term counts of every chunk; chunk ids must be unique. ``terms``: texts cut already.

    Rows that share an id and a length nevertheless count as one chunk.
    """
    cut = tokens(text) if terms is None else F.col(terms)
    listed = chunks.select(F.col(chunk_id).alias("chunk_id"), cut.alias("_terms"))
    lists = posting_lists(listed.withColumnRenamed("_terms", "terms"))
    rows = lists.select("term", F.inline(F.arrays_zip("chunk_ids", "tfs", "dls")))
    postings = rows.toDF("term", "chunk_id", "tf", "dl").withColumns(
        {c: F.col(c).cast("bigint") for c in ("tf", "dl")}
    )
    frequencies = lists.groupBy("term").agg(F.sum(F.size("chunk_ids")).alias("df"))
    stats = listed.agg(
        F.count("*").alias("n_chunks"), F.avg(F.size("_terms")).alias("avg_dl")
    )
    forward = listed.withColumnRenamed("_terms", "terms")
    return LexicalIndex(postings, frequencies, stats, forward, lists=lists)


def posting_lists(forward: DataFrame) -> DataFrame:
    """(term, chunk_ids, tfs, dls): postings of (chunk_id, terms), several lists a term.

    Rows are counted where they are, without a shuffle. Only rows whose id occurs again,
    which are counted first, meet by (chunk, term).
    """
    ids = F.array("chunk_id")
    repeated = forward.groupBy("chunk_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("chunk_id")
    if not repeated.take(1):
        return _listed_in_task(forward)
    repeated = materialize(repeated, "repeated-chunks").select(F.col("chunk_id").alias("_again"))
    again = F.col("chunk_id").eqNullSafe(F.col("_again"))
    shared = (
        forward.join(repeated, again, "left_semi")
        .select("chunk_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
        .filter(F.col("term").isNotNull())
        # (chunk, term) is spread evenly even when one term or one chunk is hot.
        .groupBy("chunk_id", "term", "dl")
        .agg(F.count("*").cast("int").alias("tf"))
        .select("term", ids.alias("chunk_ids"), F.array("tf").alias("tfs"), F.array("dl").alias("dls"))
    )
    return _listed_in_task(forward.join(repeated, again, "left_anti")).unionByName(shared)


def _listed_in_task(forward: DataFrame) -> DataFrame:
    schema = T.StructType([
        T.StructField("term", T.StringType()),
        T.StructField("chunk_ids", T.ArrayType(forward.schema["chunk_id"].dataType)),
        T.StructField("tfs", T.ArrayType(T.IntegerType())),
        T.StructField("dls", T.ArrayType(T.IntegerType())),
    ])
    kind = to_arrow_type(forward.schema["chunk_id"].dataType)
    types = [pa.string(), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def lists(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ids, terms = (pa.concat_arrays([c.cast(t) for c in column.chunks])
                      for column, t in zip(rows.columns, (kind, pa.list_(pa.string()))))
        length = pa.compute.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = terms.flatten().dictionary_encode()
        known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
        code = coded.indices.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        n = max(1, len(length))
        pair, tf = np.unique(code * n + np.repeat(np.arange(len(length)), length)[known], return_counts=True)
        term, row = np.divmod(pair, n)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        offsets = pa.array(np.append(first, len(term)), pa.int32())
        values = (ids.take(pa.array(row)), pa.array(tf, pa.int32()), pa.array(length[row], pa.int32()))
        columns = [coded.dictionary.take(pa.array(term[first]))]
        columns += [pa.ListArray.from_arrays(offsets, v) for v in values]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            size = pa.compute.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
            # Long texts are counted a few at a time.
            part = np.cumsum(size, dtype=np.int64) // LIST_WORDS
            edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            for lo, hi in zip(edges, edges[1:]):
                held.append(batch.slice(lo, hi - lo))
                words += int(size[lo:hi].sum())
                if words >= LIST_WORDS:
                    yield lists(held)
                    held, words = [], 0
        if held:
            yield lists(held)

    return forward.select("chunk_id", "terms").mapInArrow(run, schema)


def term_bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int")


def write_lexical_index(index: LexicalIndex, path: str, batch: str) -> None:
    """Add a batch of chunks to the stored index; readers name the batches they trust.

    Postings are stored in blocks by impact, in a folder per batch and term bucket. Lists of
    postings are shuffled once, to the task that cuts and writes the blocks of their terms; a
    frequent term is dealt to several tasks. Frequencies and statistics are sums, so a batch
    brings its own.
    """
    from matchloom.operators.impact import impact_blocks

    added = materialize(
        index.stats.select(
            "n_chunks", F.coalesce(F.col("n_chunks") * F.col("avg_dl"), F.lit(0.0)).alias("total_dl")
        ),
        "stats",
    )
    size = added.first()
    files = max(8, int(size["total_dl"] // FILE_ROWS))
    avg_dl = size["total_dl"] / size["n_chunks"] if size["n_chunks"] else 0.0
    lists = posting_lists(index.forward) if index.lists is None else index.lists
    blocks = impact_blocks(deal_lists(lists, size["total_dl"], files), avg_dl)
    (
        blocks.withColumns({"term_bucket": term_bucket(), "batch": F.lit(batch)})
        .sortWithinPartitions("term_bucket", "term")
        .write.mode("append").option("compression", "zstd")
        .partitionBy("batch", "term_bucket")
        .parquet(f"{path}/postings")
    )
    # Counted from the written blocks: no second tokenisation.
    written = index.forward.sparkSession.read.schema("term string, n bigint, batch string").parquet(f"{path}/postings")
    frequencies = written.filter(F.col("batch") == batch).groupBy("term").agg(F.sum("n").alias("df"))
    add_counts(frequencies, added, path, batch)


def deal_lists(lists: DataFrame, words: float, files: int) -> DataFrame:
    """Lists with a number ``_part``, laid out so that a task has all of a (term, part).

    Terms of more than ``FILE_ROWS`` postings, of which there are at most words / FILE_ROWS,
    have several parts, and those of one bucket go to as many tasks as it has files.
    """
    parts = F.lit(1)
    if words > FILE_ROWS:
        # A task has a list of a term for each LIST_WORDS; a frequent term has long ones.
        long = F.size("chunk_ids") > FILE_ROWS // (1 + int(words // LIST_WORDS)) // 16
        df = lists.filter(long).groupBy("term").agg(F.sum(F.size("chunk_ids")).alias("df"))
        df = df.filter(F.col("df") > FILE_ROWS)
        many = df.select("term", F.ceil(F.col("df") / FILE_ROWS).alias("_parts"))
        lists = lists.join(F.broadcast(many), "term", "left")
        parts = F.coalesce("_parts", F.lit(1))
    # The lists of a frequent term are as many as the batches that tasks counted.
    lists = lists.withColumn("_part", F.pmod(F.xxhash64(F.element_at("chunk_ids", 1)), parts).cast("int"))
    spread = max(1, files // TERM_BUCKETS)
    to = term_bucket() * spread + F.pmod(F.xxhash64("term", "_part"), F.lit(spread)).cast("int")
    lists = lists.select("term", "chunk_ids", "tfs", "dls", "_part", to.alias("_to"))
    return _shuffled_in_pieces(lists, files).sortWithinPartitions("term", "_part")


def _shuffled_in_pieces(lists: DataFrame, files: int) -> DataFrame:
    """Rows of ``lists`` in ``files`` partitions by ``_to``, which goes.

    What a task holds for one ``_to`` travels as one compressed piece: lists of a few rows
    hardly shrink on their own.
    """
    schema = T.StructType([f for f in lists.schema if f.name != "_to"])
    inner = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def pieces(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        to = rows["_to"].to_numpy().astype(np.int64)
        order = np.argsort(to, kind="stable")
        rows = rows.drop_columns(["_to"]).take(pa.array(order)).cast(inner).combine_chunks()
        first = np.flatnonzero(np.diff(to[order], prepend=-1))
        payload = [
            _piece(rows.slice(at, n))
            for at, n in zip(first.tolist(), np.diff(np.append(first, len(to))).tolist())
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(to[order][first], pa.int32()), pa.array(payload, pa.binary())], names=["_to", "piece"]
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                words += len(batch.column("tfs").flatten())
            if words >= LIST_WORDS:
                yield pieces(held)
                held, words = [], 0
        if held:
            yield pieces(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column("piece"):
                yield from pa.ipc.open_stream(piece.as_buffer())

    packed = lists.mapInArrow(pack, "_to int, piece binary").repartition(files, "_to")
    return packed.mapInArrow(unpack, schema)


def _piece(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def add_counts(frequencies: DataFrame, totals: DataFrame, path: str, batch: str) -> None:
    """Add to document frequencies (term, df) and to the totals (n_chunks, total_dl); less than
    zero where chunks are withdrawn."""
    (
        frequencies.withColumns({"term_bucket": term_bucket(), "batch": F.lit(batch)})
        .repartition("term_bucket").sortWithinPartitions("term")
        .write.mode("append").partitionBy("batch", "term_bucket").parquet(f"{path}/frequencies")
    )
    totals.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{path}/stats")


def read_lexical_index(
    spark: SparkSession, path: str, batches: list[str], forward: DataFrame | None = None,
    withdrawn: DataFrame | None = None,
) -> LexicalIndex:
    """The index of the named batches. ``forward`` is the table of chunks with their
    ``terms``; ``withdrawn`` (chunk_id, batch) says which stored postings no longer count."""
    from matchloom.operators.impact import explode_blocks

    trusted = F.col("batch").isin(batches)
    frequencies = (
        spark.read.parquet(f"{path}/frequencies").filter(trusted)
        .groupBy("term_bucket", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    )
    stats = spark.read.parquet(f"{path}/stats").filter(trusted).agg(
        F.sum("n_chunks").alias("n_chunks"),
        F.try_divide(F.sum("total_dl"), F.sum("n_chunks")).alias("avg_dl"),
    )
    blocks = spark.read.parquet(f"{path}/postings").filter(trusted)
    postings = explode_blocks(blocks)
    if withdrawn is not None:
        postings = postings.join(withdrawn, ["chunk_id", "batch"], "left_anti")
    return LexicalIndex(
        postings.select("term", "chunk_id", "tf", "dl"), frequencies, stats, forward, blocks, withdrawn
    )


def query_terms(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """(query_id, term, qtf): a term repeated in the query counts each time."""
    exploded = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(query)).alias("term"))
    return exploded.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


class QueryWeights(NamedTuple):
    """Query terms with their weights, as arrays that travel with the task function."""

    queries: list  # query ids
    vocabulary: list[str]
    first: np.ndarray  # where each term's rows begin
    query: np.ndarray  # positions in queries
    weight: np.ndarray


def _query_weights(index: LexicalIndex, terms: DataFrame) -> QueryWeights:
    """idf times query frequency of every term that the corpus has; ``terms`` is bounded."""
    names = F.broadcast(terms.select("term").distinct())
    known = index.frequencies.join(names, "term")
    n = index.stats.select("n_chunks").scalar()
    df = F.col("df").cast("double")
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    rows = (
        terms.join(F.broadcast(known), "term")
        .select("query_id", "term", (F.col("qtf") * idf).alias("weight"))
        .collect()
    )
    return _as_weights(rows)


def _as_weights(rows: list) -> QueryWeights:
    """Rows of (query_id, term, weight) as arrays."""
    queries = sorted({r["query_id"] for r in rows})
    place = {q: i for i, q in enumerate(queries)}
    rows.sort(key=lambda r: r["term"])
    vocabulary = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    of_term = np.array([number[r["term"]] for r in rows], np.int64)
    return QueryWeights(
        queries, vocabulary, np.searchsorted(of_term, np.arange(len(vocabulary) + 1)),
        np.array([place[r["query_id"]] for r in rows], np.int64),
        np.array([r["weight"] for r in rows], float),
    )


def _best_in_task(
    weights: QueryWeights, kind: pa.DataType, avg_dl: float, k: int, k1: float, b: float,
    own: DistinctFilters | None = None,
):
    """A task function: its chunks' scores, of which each query keeps the best ``k``.

    Chunks are scored a block at a time, so that block times queries stays bounded.
    ``own`` are the filters of the weights' queries; what one refuses has no score.
    """
    block = max(1, SCORE_CELLS // max(1, len(weights.queries)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        vocabulary = pa.array(weights.vocabulary, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                score = _block_scores(part.column("terms"), vocabulary, weights, avg_dl, k1, b)
                score = np.round(score, SCORE_DIGITS)
                if own is not None:
                    score[~own.allowed(part)] = 0.0
                yield part.column("chunk_id"), score

    return lambda batches: _best_of(scored(batches), weights, kind, k)


def _best_of(
    scored: Iterator[tuple[pa.Array, np.ndarray]], weights: QueryWeights, kind: pa.DataType, k: int
) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of every query, from blocks of chunk ids and their (chunk, query) scores."""
    n_queries = len(weights.queries)
    least = np.full(n_queries, np.finfo(float).tiny)
    kept, ids = [], []
    for names, score in scored:
        if len(score) > k:
            least = np.maximum(least, np.partition(score, -k, axis=0)[-k])
        chunk, query = np.nonzero(score >= least)
        kept.append((query, score[chunk, query]))
        ids.append(names.take(pa.array(chunk)))
        if sum(len(x) for x in ids) > 4 * k * n_queries:
            kept, ids = _cut(kept, ids, k)
    if kept:
        kept, ids = _cut(kept, ids, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.queries[q] for q in kept[0][0]], kind), ids[0], pa.array(kept[0][1])],
            names=["query_id", "chunk_id", "score"],
        )


def best_from_postings(weights: QueryWeights, kind: pa.DataType, avg_dl: float, k: int, k1: float, b: float):
    """A task function over postings (chunk_id, term, tf, dl) that lie by chunk: like
    :func:`_best_in_task`, of the scores that these postings add up to."""
    block = max(1, SCORE_CELLS // max(1, len(weights.queries)))

    def scores(rows: pa.Table, chunk: np.ndarray, vocabulary: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
        first = np.flatnonzero(np.diff(chunk, prepend=-1))
        number = np.cumsum(np.diff(chunk, prepend=-1) != 0) - 1
        found = pa.compute.index_in(rows.column(1), value_set=vocabulary).to_numpy().astype(np.int64)
        tf, dl = (rows.column(c).to_numpy().astype(float) for c in (2, 3))
        norm = 1.0 - b + b * dl / avg_dl if avg_dl else np.ones(len(dl))
        value = tf * (k1 + 1.0) / (tf + k1 * norm)
        names = rows.column(0).combine_chunks()
        names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
        for at in range(0, len(first), block):
            lo = first[at]
            hi = first[at + block] if at + block < len(first) else len(chunk)
            n = min(block, len(first) - at)
            score = _added(number[lo:hi] - at, found[lo:hi], value[lo:hi], n, weights)
            yield names.take(pa.array(first[at : at + n])), np.round(score, SCORE_DIGITS)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        vocabulary, held, size = pa.array(weights.vocabulary, pa.string()), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < POSTING_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            chunk = _codes(rows.column(0))
            # The last chunk may go on in the next batch.
            whole = int(np.flatnonzero(chunk != chunk[-1])[-1]) + 1 if (chunk != chunk[-1]).any() else 0
            if whole:
                yield from scores(rows.slice(0, whole), chunk[:whole], vocabulary)
            held, size = rows.slice(whole).to_batches(), rows.num_rows - whole
        if size:
            rows = pa.Table.from_batches(held)
            yield from scores(rows, _codes(rows.column(0)), vocabulary)

    return lambda batches: _best_of(scored(batches), weights, kind, k)


def _codes(names: pa.ChunkedArray) -> np.ndarray:
    coded = names.combine_chunks()
    coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
    return coded.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(kept: list, ids: list, k: int) -> tuple[list, list]:
    query, score = (np.concatenate(x) for x in zip(*kept))
    names = pa.concat_arrays(ids)
    place = pa.compute.rank(names, null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
    order = np.lexsort((place, -score, query))
    query, score = query[order], score[order]
    first = np.arange(len(query)) - np.searchsorted(query, query) < k
    return [(query[first], score[first])], [names.take(pa.array(order[first]))]


def _block_scores(
    terms: pa.Array, vocabulary: pa.Array, weights: QueryWeights, avg_dl: float, k1: float, b: float
) -> np.ndarray:
    """BM25 of every chunk of a block for every query; 0 without a common term."""
    n = len(terms)
    length = pa.compute.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False)
    found = pa.compute.index_in(terms.flatten(), value_set=vocabulary)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    term = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    chunk = np.repeat(np.arange(n), length)[known]
    pair, tf = np.unique(chunk * max(1, len(vocabulary)) + term, return_counts=True)
    chunk, term = np.divmod(pair, max(1, len(vocabulary)))
    norm = 1.0 - b + b * length[chunk] / avg_dl if avg_dl else np.ones(len(chunk))
    value = tf * (k1 + 1.0) / (tf + k1 * norm)
    return _added(chunk, term, value, n, weights)


def _added(chunk: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, weights: QueryWeights) -> np.ndarray:
    """(chunk, query) scores of ``n`` chunks. Each pair meets the queries of its term."""
    size = weights.first[term + 1] - weights.first[term]
    row = np.repeat(weights.first[term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    cell = np.repeat(chunk, size) * len(weights.queries) + weights.query[row]
    score = np.bincount(
        cell, np.repeat(value, size) * weights.weight[row], n * len(weights.queries)
    )
    return score.reshape(n, len(weights.queries))


def _own_filters(
    weights: QueryWeights, own_terms: DataFrame, requests: DataFrame, filters: RequestFilters
) -> DistinctFilters:
    """The filters of the weights' queries, in their order; these are at most ``QUERY_ROWS``."""
    names = own_terms.select("query_id").distinct()
    asked = requests.select("query_id", *filters.asked(requests)).join(F.broadcast(names), "query_id").toArrow()
    place = pa.compute.index_in(
        pa.array(weights.queries, asked.column("query_id").type), value_set=asked.column("query_id").combine_chunks()
    )
    return filters.distinct(asked.take(place))


def bm25_top_k(
    index: LexicalIndex,
    terms: DataFrame,
    k: int,
    *,
    forward: DataFrame | None = None,
    requests: DataFrame | None = None,
    filters: RequestFilters | None = None,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """(query_id, chunk_id, score, rank): best ``k`` chunks per query, ties by id.

    A chunk's terms stay together: every task scores its own chunks and lets ``k`` rows
    per query leave. ``forward`` (chunk_id, terms) says which chunks take part; the
    statistics stay those of the whole corpus. Very many queries come in parts. With
    ``filters`` a query of ``requests`` gets the chunks that its own filter allows;
    ``forward`` then has the columns they look at.
    """
    spark = terms.sparkSession
    forward = index.forward if forward is None else forward
    schema = T.StructType(
        [terms.schema["query_id"], forward.schema["chunk_id"], T.StructField("score", T.DoubleType())]
    )
    size = terms.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("q")).first()
    parts = max(1, -(-size["n"] // TERM_ROWS), -(-size["q"] // QUERY_ROWS))
    avg_dl = index.stats.first()["avg_dl"] or 0.0
    kind = to_arrow_type(terms.schema["query_id"].dataType)
    found = []
    for part in range(parts if k > 0 else 0):
        own = terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        weights = _query_weights(index, own)
        if weights.queries:
            own = filters and _own_filters(weights, own_terms=own, requests=requests, filters=filters)
            run = _best_in_task(weights, kind, avg_dl, k, k1, b, own)
            columns = filters.looked_at() if filters else []
            found.append(forward.select("chunk_id", "terms", *columns).mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    best = reduce(DataFrame.unionByName, found)
    return top_k_per_group(best, ["query_id"], order, k, salt_by=["chunk_id"])
