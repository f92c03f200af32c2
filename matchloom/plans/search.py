"""Hybrid trial search for a table of requests."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from matchloom.functions.text import tokens
from matchloom.operators import impact, lexical
from matchloom.operators.embedding import TOLERATED, Embedder, embed_column, embed_input
from matchloom.operators.filters import RequestFilters
from matchloom.operators.lexical import LexicalIndex
from matchloom.operators.retrieval import (
    best_chunk_per_trial,
    enrich_trials,
    min_enrollment_filter,
    phase_status_filter,
    rrf_fuse,
)
from matchloom.operators.scale import BROADCAST_ROWS, lookup_join
from matchloom.operators.similarity import top_k_by_dot
from matchloom.sources.sinks import new_chunks
from matchloom.storage import materialize

LEGS = ("dense", "sparse")
# What a request may ask of the chunks before they are scored.
CHUNK_FILTERS = RequestFilters(
    equal=(("phase", "phase"), ("status", "status")), at_least=(("min_enrollment", "enrollment"),)
)
# Requests that are answered from the postings of their terms; more share a scan of all chunks.
POSTING_QUERIES = 16


class IndexCounts(NamedTuple):
    """Chunks that a search can find, and those the model refused."""

    indexed: int
    rejected: int


class SearchIndex(NamedTuple):
    """Chunks with vectors and metadata columns, their postings, and the trials."""

    chunks: DataFrame  # chunk_id, nct_id, chunk_index, text, embedding, phase, status, enrollment, ...
    lexical: LexicalIndex
    trials: DataFrame  # nct_id, text, conditions, minimum_age, maximum_age, enrollment, ...


def write_search_index(
    chunks: DataFrame,
    path: str,
    *,
    embedder: Embedder | None = None,
    metadata: str | None = None,
    tolerate: tuple[type[BaseException], ...] = TOLERATED,
) -> IndexCounts:
    """Embed the chunks and write the dense and sparse parts of the index.

    Chunks that the model refuses with a tolerated error stay beside the index, with the
    reason; :func:`rejected_chunks` reads them. Both numbers are returned.
    """
    return _add_chunks(chunks, path, "overwrite", embedder, metadata, tolerate)


def extend_search_index(
    chunks: DataFrame,
    path: str,
    *,
    embedder: Embedder | None = None,
    metadata: str | None = None,
    tolerate: tuple[type[BaseException], ...] = TOLERATED,
) -> IndexCounts:
    """Add the chunks that the index at ``path`` does not have yet; the first call makes it.

    Only new chunks are embedded. Postings, frequencies and statistics grow with them, so
    a search finds what it would in an index built at once. Repeating a call adds nothing;
    chunks that were rejected before are tried again.
    """
    fresh = materialize(chunks, "incoming")
    if committed_batches(chunks.sparkSession, path):
        fresh = materialize(new_chunks(fresh, _stored(chunks.sparkSession, path, rejected=False)), "fresh")
    return _add_chunks(fresh, path, "append", embedder, metadata, tolerate)


def replace_in_index(
    chunks: DataFrame,
    path: str,
    *,
    withdrawn: DataFrame | None = None,
    key: str = "nct_id",
    embedder: Embedder | None = None,
    metadata: str | None = None,
    tolerate: tuple[type[BaseException], ...] = TOLERATED,
) -> IndexCounts:
    """Put the chunks of changed trials in place of their earlier ones, and withdraw trials.

    ``chunks`` holds all chunks of each changed or new trial; ``withdrawn`` has the ``key``
    of trials that go. What the index held of either is marked as withdrawn and taken out of
    the frequencies and totals by negative counts; nothing stored is rewritten. Afterwards a
    search answers like an index built anew, and a failure on the way changes nothing.
    """
    gone = chunks.select(key).limit(0) if withdrawn is None else withdrawn.select(key)
    return _add_chunks(chunks, path, "append", embedder, metadata, tolerate, gone=gone)


def _add_chunks(
    chunks: DataFrame, path: str, mode: str, embedder: Embedder | None, metadata: str | None, tolerate,
    gone: DataFrame | None = None,
) -> IndexCounts:
    """Write a batch and commit it: all of its parts are seen together, or none.

    Every part lies in folders of the batch's own id. The last write adds the id to the
    manifest, which readers go by; a batch that ended before that is never read. With
    ``gone`` the batch takes the place of earlier chunks of these keys and of its own.
    """
    spark = chunks.sparkSession
    batch = f"b{uuid.uuid4().hex}"
    text = embed_input("text", F.col(metadata) if metadata else None)
    embedded = embed_column(chunks, text, embedder=embedder, tolerate=tolerate)
    # A chunk's terms stand beside its metadata, where filters reach both.
    embedded = embedded.withColumn("terms", tokens("text"))
    # One pass of the model writes both kinds, each in a folder of its own.
    marked = embedded.withColumns({"rejected": F.col("error").isNotNull(), "batch": F.lit(batch)})
    marked.write.mode("append").option("compression", "zstd").partitionBy("batch", "rejected").parquet(
        f"{path}/chunks"
    )
    written = spark.read.parquet(f"{path}/chunks").filter(F.col("batch") == batch)
    if gone is not None and committed_batches(spark, path):
        # The batch is written but not committed, so what is stored is what came before it.
        keys = written.select(*gone.columns).union(gone)
        _withdraw(spark, path, materialize(keys.distinct(), "replaced"), batch)
    written = written.filter(~F.col("rejected")).select("chunk_id", "text", "terms")
    lexical.write_lexical_index(lexical.build_lexical_index(written, terms="terms"), f"{path}/lexical", batch)
    # An index that is written anew starts the next generation.
    generation = _generation(spark, path)
    commit = [(batch, generation + 1 if mode == "overwrite" else max(generation, 1))]
    spark.createDataFrame(commit, "batch string, generation int").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    indexed = written.count() if gone is None else _stored(spark, path, rejected=False).count()
    return IndexCounts(indexed, rejected_chunks(spark, path).count())


def _withdraw(spark: SparkSession, path: str, keys: DataFrame, batch: str) -> None:
    """Mark stored chunks of the given trials as withdrawn, with negative counts."""
    def old(rejected: bool, *columns) -> DataFrame:
        stored = _stored(spark, path, rejected=rejected, batches=True).select(*keys.columns, *columns)
        return stored.join(keys, keys.columns, "left_semi")

    # Terms, the bulk of a chunk, are read a second time rather than written once more.
    columns = [c for c in ("chunk_id",) if c not in keys.columns] + [F.col("batch").alias("of_batch")]
    gone = old(False, *columns, F.size("terms").alias("n_terms")).unionByName(
        old(True, *columns, F.lit(None).cast("int").alias("n_terms")).withColumn("refused", F.lit(True)),
        allowMissingColumns=True,
    )
    gone = materialize(gone.select("chunk_id", "of_batch", "n_terms", "refused"), "withdrawn")
    marks = gone.select("chunk_id", "of_batch", F.lit(batch).alias("batch"))
    marks.write.mode("append").partitionBy("batch").parquet(f"{path}/withdrawn")
    terms = old(False, F.array_distinct("terms").alias("terms")).select(F.explode("terms").alias("term"))
    frequencies = terms.groupBy("term").agg((-F.count("*")).alias("df"))
    totals = gone.filter(F.col("refused").isNull()).agg(
        (-F.count("*")).alias("n_chunks"),
        F.coalesce(-F.sum("n_terms").cast("double"), F.lit(0.0)).alias("total_dl"),
    )
    lexical.add_counts(frequencies, totals, f"{path}/lexical", batch)


def _manifest(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(batch, generation) of all commits: one row a batch."""
    try:
        return [tuple(r) for r in spark.read.schema("batch string, generation int").parquet(f"{path}/manifest").collect()]
    except AnalysisException:
        return []


def _generation(spark: SparkSession, path: str) -> int:
    return max((g for _, g in _manifest(spark, path)), default=0)


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    """The batches that make up the index now."""
    found = _manifest(spark, path)
    last = max((g for _, g in found), default=0)
    return sorted(b for b, g in found if g == last)


def _withdrawn(spark: SparkSession, path: str) -> DataFrame | None:
    """(chunk_id, batch) of stored chunks that no longer count."""
    try:
        marks = spark.read.parquet(f"{path}/withdrawn")
    except AnalysisException:
        return None
    marks = marks.filter(F.col("batch").isin(committed_batches(spark, path)))
    return marks.select("chunk_id", F.col("of_batch").alias("batch")).distinct()


def _stored(spark: SparkSession, path: str, *, rejected: bool, batches: bool = False) -> DataFrame:
    stored = spark.read.parquet(f"{path}/chunks").filter(
        F.col("batch").isin(committed_batches(spark, path)) & (F.col("rejected") == rejected)
    )
    marks = _withdrawn(spark, path)
    if marks is not None:
        stored = stored.join(marks, ["chunk_id", "batch"], "left_anti")
    return stored.drop("rejected") if batches else stored.drop("rejected", "batch")


def rejected_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks without a vector, with the reason in ``error``; not those accepted since."""
    refused = _stored(spark, path, rejected=True).drop("embedding", "terms").dropDuplicates(["chunk_id"])
    accepted = _stored(spark, path, rejected=False).select("chunk_id")
    return refused.join(accepted, "chunk_id", "left_anti").select(*refused.columns)


def read_search_index(spark: SparkSession, path: str, trials: DataFrame) -> SearchIndex:
    chunks = _stored(spark, path, rejected=False).drop("error")
    forward = chunks.select("chunk_id", "terms")
    stored = lexical.read_lexical_index(
        spark, f"{path}/lexical", committed_batches(spark, path), forward, _withdrawn(spark, path)
    )
    return SearchIndex(chunks, stored, trials)


def rank_chunks(
    index: SearchIndex,
    queries: DataFrame,
    *,
    k: int,
    pool: int | None = None,
    legs: tuple[str, ...] = LEGS,
    embedder: Embedder | None = None,
    queries_at_most: int | None = None,
    filters: RequestFilters | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, rank): fused top ``k`` chunks of every query.

    ``queries`` has query_id and query. Each leg contributes ``pool`` rows. With
    ``filters`` both legs score, in one scan each, the chunks that a query's own filter
    allows; the filters' columns stand beside query and in the chunk table.
    """
    pool = pool or k
    chunks = index.chunks
    ranked = []
    if "dense" in legs:
        vectors = embed_column(queries, "query", embedder=embedder)
        ranked.append(top_k_by_dot(vectors, chunks, pool, queries_at_most=queries_at_most, filters=filters))
    if "sparse" in legs:
        terms = lexical.query_terms(queries, "query_id", "query")
        few = queries_at_most is not None and queries_at_most <= POSTING_QUERIES
        if few and filters is None and index.lexical.blocks is not None:
            # A few requests read the postings of their own terms; many share one scan.
            ranked.append(impact.bm25_from_blocks(index.lexical, terms, pool))
        else:
            forward = index.lexical.forward if filters is None else chunks
            ranked.append(
                lexical.bm25_top_k(
                    index.lexical, terms, pool, forward=forward, requests=queries, filters=filters
                )
            )
    return rrf_fuse(*ranked, k=k)


def search_trials(
    index: SearchIndex,
    requests: DataFrame,
    *,
    top_k: int = 5,
    pool: int | None = None,
    legs: tuple[str, ...] = LEGS,
    embedder: Embedder | None = None,
    filter_mode: str = "post",
    enrich: bool = True,
) -> DataFrame:
    """Best chunk of each found trial, per request.

    ``requests``: query_id, query and optionally phase, status, min_enrollment.
    With ``filter_mode='post'`` the filters look at the ``top_k`` hits only, so a
    filtered search may return fewer; with ``'pre'`` they are applied to the chunks
    before they are scored: one pass over the chunks, however many filters there are.

    Returns query_id, nct_id, chunk_id, rank, chunk_similarity_score, chunk_text,
    the metadata columns and, with ``enrich``, full_text, conditions, missing_trial.
    """
    n_requests = requests.count()
    bounded = n_requests * top_k <= BROADCAST_ROWS
    asked = requests
    for name, kind in (("phase", "string"), ("status", "string"), ("min_enrollment", "bigint")):
        if name not in asked.columns:
            asked = asked.withColumn(name, F.lit(None).cast(kind))
    if filter_mode not in ("post", "pre"):
        raise ValueError("filter_mode is 'post' or 'pre'")
    hits = rank_chunks(
        index, asked, k=top_k, pool=pool, legs=legs, embedder=embedder, queries_at_most=n_requests,
        filters=CHUNK_FILTERS if filter_mode == "pre" else None,
    )
    chunks = index.chunks.drop("embedding", "terms")
    # Every hit is a chunk of this table, so an inner join loses none.
    found = lookup_join(chunks, hits, ["chunk_id"], small_is_bounded=bounded)
    wanted = asked.select(
        "query_id",
        F.col("phase").alias("_phase"),
        F.col("status").alias("_status"),
        F.col("min_enrollment").alias("_min_enrollment"),
    )
    kept = (
        found.join(wanted, "query_id")
        .filter(
            phase_status_filter(F.col("_phase"), F.col("_status"))
            & min_enrollment_filter(F.col("_min_enrollment"))
        )
        .drop("_phase", "_status", "_min_enrollment")
    )
    best = best_chunk_per_trial(kept).withColumns(
        {"chunk_similarity_score": F.round("score", 3), "chunk_text": F.col("text")}
    )
    # A few rows that took a whole search: written, so that it runs once.
    best = materialize(best.drop("text"), "hits")
    return enrich_trials(best, index.trials, hits_bounded=bounded) if enrich else best


def search_summary(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per request: its filters and how many trials were found."""
    counts = hits.groupBy("query_id").agg(F.count("*").alias("count"))
    return requests.join(counts, "query_id", "left").withColumn(
        "count", F.coalesce("count", F.lit(0).cast("bigint"))
    )
