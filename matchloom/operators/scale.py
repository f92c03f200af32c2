"""Building blocks that keep plans sound when data or keys grow.

* a side is broadcast only after it was counted; there is always another way,
* a hot key never has to fit in one task,
* numbering and sampling work without a single-task sort of everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.storage import materialize

# Row bound under which a narrow table (keys, ids, scores) may be broadcast.
BROADCAST_ROWS = 200_000
# Rows of one key that one task may be given in a shuffled join.
HOT_ROWS = 5_000_000
# Inputs up to this many rows are dealt out evenly before costly row-local work.
SPREAD_ROWS = 1_000_000
# Parts a large top-k group is first cut into.
SALTS = 32
# Largest k for which Spark limits each map task before the window's shuffle.
MAP_SIDE_RANK_LIMIT = 1000
# Ranges of a key in which the rows of each group are counted before a sort.
KEY_RANGES = 64


def is_small(df: DataFrame, bound: int = BROADCAST_ROWS) -> bool:
    """Counted, not estimated. A count moves one number per task, a limit would not."""
    return df.count() <= bound


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a small input out to all cores before costly row-local work.

    A large input already comes in as many partitions as it has splits and is left
    alone; shuffling it would only cost.
    """
    if not is_small(df, SPREAD_ROWS):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows; there are at most rows / hot_rows.

    Only the key columns are read, and copies of a key collapse in the map tasks.
    """
    counts = df.select(*keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") > hot_rows).drop("_n")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    *,
    how: str = "inner",
    small_is_bounded: bool,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join a large table with a usually small one; inner, left, left_semi, left_anti.

    With ``small_is_bounded`` (the caller counted it, or knows its bound) the small
    side is broadcast and ``big`` is not shuffled. Otherwise the hot keys of ``big``
    are found first. Their rows stay where they are and meet the few matching rows of
    ``small`` by broadcast; all other rows take a shuffled join. Adaptive execution
    splits what skew is left, but may not broadcast: it goes by compressed bytes, and
    millions of like rows are few of those.
    """
    keys = list(on)
    if small_is_bounded:
        return big.join(F.broadcast(small), keys, how)
    unhinted, small = small, small.hint("merge")
    hot = [tuple(r) for r in hot_keys(big, keys, hot_rows).take(BROADCAST_ROWS + 1)]
    if not hot or len(hot) > BROADCAST_ROWS:
        return big.join(small, keys, how)
    schema = big.select(*keys).schema
    hot_table = big.sparkSession.createDataFrame(hot, schema)
    hot_small = unhinted.join(F.broadcast(hot_table), keys, "left_semi")
    if not is_small(hot_small):
        return big.join(small, keys, how)
    hot_part = big.join(F.broadcast(hot_table), keys, "left_semi")
    rest = big.join(F.broadcast(hot_table), keys, "left_anti")
    return hot_part.join(F.broadcast(hot_small), keys, how).unionByName(
        rest.join(small, keys, how)
    )


def top_k_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1 in column ``rank``.

    For moderate ``k`` Spark keeps only ``k`` rows per group in each map task
    before the shuffle. For larger ``k`` the group is first cut to ``k`` within
    salted parts, so a group holding most rows is ranked by many tasks.
    """
    if k <= 0:
        return df.withColumn(rank, F.lit(0)).filter(F.lit(False))
    final = W.partitionBy(*group).orderBy(*order)
    if k > MAP_SIDE_RANK_LIMIT:
        by = list(salt_by or df.columns)
        part = W.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
            .withColumn("_part_rank", F.row_number().over(part))
            .filter(F.col("_part_rank") <= k)
            .drop("_part_rank", "_salt")
        )
    return df.withColumn(rank, F.row_number().over(final)).filter(F.col(rank) <= k)


def without_late_rows(df: DataFrame, group: Sequence[str], key: str, k: int) -> DataFrame:
    """``df`` without most of the rows that cannot be among the first ``k`` of their group.

    Rows of each group are counted in ``KEY_RANGES`` ranges of ``key``; those in ranges after
    the one in which the k-th lies go before anything is sorted or shuffled. What is left is
    still to be ranked. Few rows, keys that are not whole numbers, and groups too many for
    their ends to be broadcast are left as they are.
    """
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        return df
    facts = df.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    if facts["n"] <= SPREAD_ROWS or facts["low"] is None:
        return df
    width = (float(facts["high"]) - float(facts["low"]) + 1.0) / KEY_RANGES
    # Never falls as the key grows; nulls are sorted first.
    at = F.coalesce(F.floor((F.col(key).cast("double") - float(facts["low"])) / width), F.lit(-1))
    names = [f"_group_{i}" for i in range(len(group))]
    counts = df.groupBy(*[F.col(c).alias(n) for c, n in zip(group, names)], at.alias("_at")).agg(
        F.count("*").alias("_n")
    )
    before = F.sum("_n").over(W.partitionBy(*names).orderBy("_at")) - F.col("_n")
    ends = counts.withColumn("_before", before).groupBy(*names).agg(
        F.max(F.when(F.col("_before") < k, F.col("_at"))).alias("_last"), F.sum("_n").alias("_all"),
    ).filter(F.col("_all") > 2 * k)
    ends = materialize(ends.drop("_all"), "ends")
    if not is_small(ends):
        return df
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(group, names)]
    marked = df.join(F.broadcast(ends), same, "left")
    return marked.filter(F.col("_last").isNull() | (at <= F.col("_last"))).select(*df.columns)


def dense_ids(
    df: DataFrame, order: str, id_col: str = "id", block_rows: int = 1 << 20
) -> DataFrame:
    """Number rows 1..N in the order of ``order``, a unique non-negative integer.

    Rows are cut into blocks of ``block_rows`` consecutive order values. Only the
    per-block counts are accumulated (in two levels); rows are numbered inside
    their block, so no task sees more than ``block_rows`` rows.
    """
    blocks_per_group = 4096
    block = F.floor(F.col(order) / F.lit(block_rows)).cast("bigint")
    group = F.floor(F.col("_block") / F.lit(blocks_per_group)).cast("bigint")
    blocked = df.withColumn("_block", block)
    counts = blocked.groupBy("_block").agg(F.count("*").alias("_n")).withColumn("_group", group)
    before = (W.unboundedPreceding, -1)
    group_base = (
        counts.groupBy("_group")
        .agg(F.sum("_n").alias("_group_n"))
        .withColumn(
            "_group_base",
            # One row per blocks_per_group * block_rows order values.
            F.coalesce(
                F.sum("_group_n").over(W.orderBy("_group").rowsBetween(*before)), F.lit(0)
            ),
        )
        .drop("_group_n")
    )
    in_group = W.partitionBy("_group").orderBy("_block").rowsBetween(*before)
    bases = (
        counts.withColumn("_in_group", F.coalesce(F.sum("_n").over(in_group), F.lit(0)))
        .join(group_base, "_group")
        .select("_block", (F.col("_group_base") + F.col("_in_group")).alias("_base"))
    )
    in_block = W.partitionBy("_block").orderBy(order)
    return (
        blocked.join(bases, "_block")
        .withColumn(id_col, (F.col("_base") + F.row_number().over(in_block)).cast("bigint"))
        .drop("_block", "_base")
    )


def sample_exact(
    df: DataFrame,
    id_col: str,
    k: int,
    seed: int = 42,
    *,
    strict: bool = True,
    heap_rows: int = 50_000,
) -> DataFrame:
    """Exactly ``k`` rows, chosen by a seeded hash of the id.

    The draw is a function of (seed, id), so it does not change with partitioning
    or a task's second attempt. A small ``k`` is a distributed top-k. For a large
    one, a histogram over 65,536 hash ranges finds the range in which the k-th row
    lies; ranges below it are kept whole by a filter and only that one is sorted.
    ``strict`` raises when there are fewer than ``k`` rows.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    if strict and df.count() < k:
        raise ValueError(f"sample of {k} rows is larger than the table")
    keyed = df.withColumn("_key", key)
    if k <= heap_rows:
        return keyed.orderBy("_key", id_col).limit(k).drop("_key")

    part = F.substring("_key", 1, 4)
    histogram = {
        r["part"]: r["n"]
        for r in keyed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    }
    taken, edge = 0, None
    for name in sorted(histogram):
        if taken + histogram[name] > k:
            edge = name
            break
        taken += histogram[name]
    if edge is None:
        return df
    whole = keyed.filter(part < edge)
    rest = keyed.filter(part == edge).orderBy("_key", id_col).limit(k - taken)
    return whole.unionByName(rest).drop("_key")
