"""Demographic summaries of matched patients, per criteria row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("gender", "race", "ethnicity")


def age_summary(patients: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, total, age_min, age_max, age_median, age_mean); exact median.

    The exact median keeps a count per distinct age, which is a small state.
    """
    return patients.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.min("age").alias("age_min"),
        F.max("age").alias("age_max"),
        F.median("age").alias("age_median"),
        F.round(F.avg("age"), 1).alias("age_mean"),
    )


def category_counts(
    patients: DataFrame, by: Sequence[str] = (), categories: Sequence[str] = CATEGORIES
) -> DataFrame:
    """(*by, dimension, value, n) for all categories in one pass over the patients."""
    entries = [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in categories]
    return (
        patients.select(*by, F.inline(F.array(*entries)))
        .groupBy(*by, "dimension", "value")
        .agg(F.count("*").alias("n"))
    )


def category_counts_by_grouping_sets(
    patients: DataFrame, categories: Sequence[str] = CATEGORIES
) -> DataFrame:
    """The same counts written as GROUPING SETS."""
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c)) for c in categories])
    name = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in categories])
    cols = [F.col(c) for c in categories]
    return (
        patients.groupingSets([[c] for c in cols], *cols)
        .agg(F.count("*").alias("n"), name.alias("dimension"), value.alias("value"))
        .select("dimension", "value", "n")
    )
