"""BM25 over stored postings in blocks ordered by impact, with exact early termination.

A term's postings are stored in blocks of about ``BLOCK_POSTINGS``, each of chunks on which
the term weighs about the same, with the largest count and the smallest length in the block.
These bound what any chunk in the block can gain from the term, whatever the statistics of
the corpus are by then. A search first adds up the best blocks of its terms; the k-th score
reached is one that the answer cannot fall below. After that it reads only blocks from
which, with the most that all other terms could add, that score is still in reach. Every
posting of a chunk in the answer is in such a block, so its score is whole. The postings read
are shuffled once by chunk, and a task scores its chunks for all queries.

Blocks lie in folders by a hash of their term, the same for every batch, and files are
sorted by term: a request reads the folders of its own terms. A term that holds a third of
all postings is many blocks, which several tasks cut.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from matchloom.functions.vectors import SCORE_DIGITS
from matchloom.operators.lexical import (
    K1, QUERY_ROWS, TERM_ROWS, B, LexicalIndex, _as_weights, best_from_postings, term_bucket,
)
from matchloom.operators.scale import top_k_per_group
from matchloom.storage import materialize

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_POSTINGS = 128
# Postings that a task cuts into blocks at a time.
CUT_POSTINGS = 200_000
LEVELS = 32
# Blocks of each query term that are added up before any is left out.
FIRST_BLOCKS = 2
# Terms that are also named to the scan, where row groups can be skipped.
NAMED_TERMS = 1000
# Scores are rounded; a bound this close to the score to reach is in reach.
SLACK = 1e-8


def gain(tf: Column, dl: Column, avg_dl: float, k1: float = K1, b: float = B) -> Column:
    """What a term adds to a chunk's score per unit of its weight."""
    norm = F.lit(1.0 - b) + F.lit(b) * dl / F.lit(avg_dl) if avg_dl else F.lit(1.0)
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * norm)


def impact_blocks(lists: DataFrame, avg_dl: float, block: int = BLOCK_POSTINGS) -> DataFrame:
    """(term, block, n, max_tf, min_dl, chunks): postings in blocks, from lists as
    :func:`matchloom.operators.lexical.deal_lists` lays them out.

    The lists of one (term, part), at most about ``FILE_ROWS`` postings, are cut together.
    """
    ids = lists.schema["chunk_ids"].dataType.elementType
    chunks = T.StructType([
        T.StructField("chunk_id", ids), T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType()),
    ])
    schema = T.StructType([
        T.StructField("term", T.StringType()), T.StructField("block", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("max_tf", T.LongType()),
        T.StructField("min_dl", T.LongType()), T.StructField("chunks", T.ArrayType(chunks)),
    ])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    id_kind = to_arrow_type(ids)

    def cut(rows: pa.Table) -> pa.RecordBatch:
        columns = [column.combine_chunks() for column in rows.columns]
        columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        term, lists_of, part = columns[0], columns[1:4], columns[4].to_numpy(zero_copy_only=False).astype(np.int64)
        coded = term.dictionary_encode()
        key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # Rows lie by (term, part); each such group is cut by itself.
        group = np.cumsum((np.diff(key, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0)) - 1
        size = pc.list_value_length(lists_of[0]).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(group, size)
        names = lists_of[0].flatten()
        tf, dl = (c.flatten().to_numpy(zero_copy_only=False) for c in lists_of[1:])
        norm = 1.0 - B + B * dl / avg_dl if avg_dl else 1.0
        level = np.floor(tf * (K1 + 1.0) / (tf + K1 * norm) / (K1 + 1.0) * LEVELS).astype(np.int64)
        # Only terms with more than one block's postings are cut by impact.
        level[np.bincount(of)[of] <= block] = 0
        order = np.lexsort((level, of))
        of, level, tf, dl = of[order], level[order], tf[order], dl[order]
        run = np.cumsum((np.diff(of, prepend=-1) != 0) | (np.diff(level, prepend=-1) != 0)) - 1
        begins = np.flatnonzero(np.diff(run, prepend=-1))
        begin = (np.arange(len(run)) - begins[run]) % block == 0
        first = np.flatnonzero(begin)
        # Numbered within (term, part).
        owner = of[first]
        number = np.arange(len(first)) - np.searchsorted(owner, owner)
        at = np.searchsorted(group, owner)
        values = pa.StructArray.from_arrays(
            [names.take(pa.array(order)).cast(id_kind), pa.array(tf, pa.int64()), pa.array(dl, pa.int64())],
            fields=list(kinds[5].value_type),
        )
        offsets = pa.array(np.append(first, len(of)), pa.int32())
        found = [
            term.take(pa.array(at)), pa.array((part[at] << 32) + number),
            pa.array(np.diff(np.append(first, len(of)))), pa.array(np.maximum.reduceat(tf, first)),
            pa.array(np.minimum.reduceat(dl, first)),
            pa.ListArray.from_arrays(offsets, values),
        ]
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(found, kinds)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            words += len(batch.column(1).flatten())
            if words < CUT_POSTINGS:
                continue
            rows = pa.Table.from_batches(held)
            last = [rows.column(c)[rows.num_rows - 1] for c in (0, 4)]
            # The last group may go on in the next batch.
            ends = pc.and_(pc.equal(rows.column(0), last[0]), pc.equal(rows.column(4), last[1]))
            whole = pc.index(ends, pa.scalar(True)).as_py()
            if whole:
                yield cut(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
            words = sum(len(b.column(1).flatten()) for b in held)
        if held:
            yield cut(pa.Table.from_batches(held))

    return lists.select("term", "chunk_ids", "tfs", "dls", "_part").mapInArrow(run, schema)


def explode_blocks(blocks: DataFrame) -> DataFrame:
    """The postings again, with all other columns of the blocks."""
    others = [c for c in blocks.columns if c not in ("chunks", "n", "max_tf", "min_dl")]
    return blocks.select(*others, F.inline("chunks"))


def _weighted(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """(query_id, term, weight, term_bucket) of the query terms that the corpus has."""
    names = materialize(terms.select("term", term_bucket().alias("term_bucket")).distinct(), "terms")
    known = _asked(index.frequencies, names).join(F.broadcast(names.select("term")), "term")
    n = index.stats.select("n_chunks").scalar()
    df = F.col("df").cast("double")
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return materialize(
        terms.join(F.broadcast(known), "term").select(
            "query_id", "term", (F.col("qtf") * idf).alias("weight"), "term_bucket"
        ),
        "weighted-terms",
    )


def _asked(table: DataFrame, names: DataFrame) -> DataFrame:
    """Rows in the folders of the named terms; a few names also reach the scan itself."""
    buckets = [r[0] for r in names.select("term_bucket").distinct().collect()]
    few = [r[0] for r in names.select("term").distinct().take(NAMED_TERMS + 1)]
    table = table.filter(F.col("term_bucket").isin(buckets))
    return table.filter(F.col("term").isin(few)) if len(few) <= NAMED_TERMS else table


def bm25_from_blocks(
    index: LexicalIndex, terms: DataFrame, k: int, *, first_blocks: int = FIRST_BLOCKS, k1: float = K1, b: float = B
) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best ``k`` chunks per query, ties by id.

    The answer of the scan over all chunks, from the postings of the query terms alone.
    """
    spark = terms.sparkSession
    avg_dl = index.stats.first()["avg_dl"] or 0.0
    size = terms.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("q")).first()
    parts = max(1, -(-size["n"] // TERM_ROWS), -(-size["q"] // QUERY_ROWS))
    schema = T.StructType([
        terms.schema["query_id"], index.blocks.schema["chunks"].dataType.elementType["chunk_id"],
        T.StructField("score", T.DoubleType()),
    ])
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    found = []
    for part in range(parts):
        own = terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part) if parts > 1 else terms
        found.append(_best_from_blocks(index, own, k, avg_dl, first_blocks, k1, b, schema, order))
    found = [f for f in found if f is not None]
    if not found or k <= 0:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
    return top_k_per_group(reduce(DataFrame.unionByName, found), ["query_id"], order, k, salt_by=["chunk_id"])


def _best_from_blocks(
    index: LexicalIndex, terms: DataFrame, k: int, avg_dl: float, first_blocks: int, k1: float, b: float,
    schema: T.StructType, order: list[Column],
) -> DataFrame | None:
    """The best of every task, of queries that travel with it.

    Blocks are chosen by term and not by query, so their number and what is shuffled do not
    grow with the queries: a block is read if one query needs it, which only completes the
    scores of others.
    """
    weighted = _weighted(index, terms)
    asked = weighted.select("query_id", "term", "weight")
    weights = _as_weights(asked.collect())  # at most TERM_ROWS
    if not weights.queries:
        return None
    blocks = _asked(index.blocks, weighted).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    keys = ["batch", "term", "block"]
    heads = blocks.select(*keys, gain(F.col("max_tf"), F.col("min_dl"), avg_dl, k1, b).alias("_gain"))
    heads = materialize(heads, "block-gains")

    def rows(chosen: DataFrame) -> DataFrame:
        found = explode_blocks(chosen)
        if index.withdrawn is not None:
            found = found.join(index.withdrawn, ["chunk_id", "batch"], "left_anti")
        return found.select("chunk_id", "term", "tf", "dl")

    first = top_k_per_group(heads, ["term"], [F.col("_gain").desc(), "batch", "block"], first_blocks, rank="_place")
    # Named blocks are a few a term.
    first = rows(blocks.join(F.broadcast(first.select(*keys)), keys, "left_semi"))
    added = F.col("weight") * gain(F.col("tf"), F.col("dl"), avg_dl, k1, b)
    scores = first.join(F.broadcast(asked), "term").groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(added), SCORE_DIGITS).alias("score")
    )
    reached = top_k_per_group(scores, ["query_id"], order, k).filter(F.col("rank") == k)
    reached = reached.select("query_id", F.col("score").alias("_reach"))
    most = heads.groupBy("term").agg(F.max("_gain").alias("_top"))
    most = asked.join(most, "term").withColumn("_most", F.col("weight") * F.col("_top"))
    limits = (
        most.join(most.groupBy("query_id").agg(F.sum("_most").alias("_all")), "query_id")
        .join(reached, "query_id", "left")
        # What this term must bring at least, for the query that asks the least of it.
        .withColumn("_least", F.coalesce("_reach", F.lit(0.0)) - (F.col("_all") - F.col("_most")) - SLACK)
        .groupBy("term").agg(F.min(F.col("_least") / F.col("weight")).alias("_need"))
    )
    limits = materialize(limits, "needed-gains")
    needed = blocks.join(F.broadcast(limits), "term").filter(
        gain(F.col("max_tf"), F.col("min_dl"), avg_dl, k1, b) >= F.col("_need") - SLACK
    ).drop("_need")
    run = best_from_postings(weights, to_arrow_type(schema["query_id"].dataType), avg_dl, k, k1, b)
    laid = rows(needed).repartition("chunk_id").sortWithinPartitions("chunk_id")
    return laid.mapInArrow(run, schema)
