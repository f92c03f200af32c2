"""Load-time quality rules: what a relational store would enforce row by row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import lenient_int
from matchloom.operators.scale import lookup_join, top_k_per_group


class Split(NamedTuple):
    """Rows that pass a rule, and the rows set aside."""

    good: DataFrame
    rejected: DataFrame


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates removed; copies are combined before the shuffle."""
    return df.dropDuplicates()


def keep_first_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; every map task sends at most one row per key."""
    first = top_k_per_group(df, key, [F.col(c) for c in order], 1, rank="_rank")
    return first.drop("_rank")


def _any_null(required: Sequence[str]):
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])


def split_nulls(df: DataFrame, required: Sequence[str]) -> Split:
    """Rows with all required columns present, and the rest with the missing names."""
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]),
        lambda c: c.isNotNull(),
    )
    bad = _any_null(required)
    return Split(
        df.filter(~bad),
        df.filter(bad).withColumn("missing_columns", F.array_join(missing, ",")),
    )


def split_by_parent(
    child: DataFrame, parent: DataFrame, key: str, *, parent_is_bounded: bool = False
) -> Split:
    """Child rows whose key exists in ``parent``, and the orphans.

    One key may own a large share of the child rows: without a bounded parent, rows of
    hot keys stay where they are and only the rest is shuffled.
    """
    keys = parent.select(key).distinct()
    args = {"on": [key], "small_is_bounded": parent_is_bounded}
    return Split(
        lookup_join(child, keys, how="left_semi", **args),
        lookup_join(child, keys, how="left_anti", **args),
    )


def load_report(
    table: str,
    df: DataFrame,
    *,
    required: Sequence[str],
    key: str | None = None,
    parent: DataFrame | None = None,
    parent_key: str | None = None,
) -> DataFrame:
    """One row (table, rows_read, added, skipped, not_found).

    Rules in the order a row meets them: unknown parent counts as not found; a null
    in a required column or a key already used counts as skipped.
    """
    if key is not None and key not in required:
        raise ValueError("the key must be among the required columns")
    bad = _any_null(required)
    if parent is not None:
        on = parent_key or key
        known = parent.select(F.col(on), F.lit(True).alias("_known")).distinct()
        df = lookup_join(df, known, [on], how="left", small_is_bounded=False)
    else:
        df = df.withColumn("_known", F.lit(True))
    lost = F.col("_known").isNull()
    counts = [
        F.count("*").alias("_rows"),
        F.count_if(lost).alias("_lost"),
        F.count_if(~lost & ~bad).alias("_complete"),
    ]
    if key is None:
        total = df.agg(*counts)
        added = F.col("_complete")
    else:
        # Counted per key first: copies of a hot key collapse in the map tasks.
        total = df.groupBy(key).agg(*counts).agg(
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("_rows"),
            F.coalesce(F.sum("_lost"), F.lit(0)).alias("_lost"),
            F.coalesce(F.sum("_complete"), F.lit(0)).alias("_complete"),
            F.count_if(F.col("_complete") > 0).alias("_added"),
        )
        added = F.col("_added")
    return total.select(
        F.lit(table).alias("table_name"),
        F.col("_rows").alias("rows_read"),
        added.alias("added"),
        (F.col("_rows") - F.col("_lost") - added).alias("skipped"),
        F.col("_lost").alias("not_found"),
    )


def project_metadata(
    metadata,
    *,
    count_key: str = "conditions_count",
    prefix: str = "condition_",
    drop: Sequence[str] = ("interventions_count", "outcomes_count"),
):
    """Metadata map without the numbered fields 1..N and without ``drop``."""
    m = F.col(metadata) if isinstance(metadata, str) else metadata
    n = F.coalesce(lenient_int(m[count_key]), F.lit(0))

    def kept(key, _value):
        suffix = F.substring(key, F.lit(len(prefix) + 1), F.length(key))
        numbered = F.startswith(key, F.lit(prefix)) & suffix.rlike("^[1-9][0-9]{0,8}$")
        index = F.when(numbered, suffix.try_cast("int"))
        return ~F.coalesce(index <= n, F.lit(False)) & ~key.isin(*drop)

    return F.map_filter(m, kept)
