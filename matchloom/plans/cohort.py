"""Cohorts: the patients found for each row of a criteria table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import clean_conditions
from matchloom.operators.ageranges import count_in_ranges, first_in_ranges
from matchloom.operators.demographics import age_summary, category_counts
from matchloom.operators.matching import (
    DEFAULT_THRESHOLD,
    PATIENT_FIELDS,
    candidate_conditions,
    count_conditions,
    eligible_patients,
    nest_conditions,
)
from matchloom.operators.scale import BROADCAST_ROWS, lookup_join
from matchloom.storage import materialize

DEFAULT_LIMIT = 100
# Lists of ages (one per profile, about 2 KB) that may be broadcast.
STEP_LISTS = 20_000


class Cohorts(NamedTuple):
    matched: DataFrame  # criteria_id, patient_id, public fields, rank
    conditions: DataFrame  # patient_id, condition, n for every matched patient
    eligible_counts: DataFrame  # criteria_id, eligible (not limited)


def _profiled(criteria: DataFrame) -> DataFrame:
    """Criteria with a ``profile``: rows that ask for the same conditions share it."""
    gender = F.col("gender") if "gender" in criteria.columns else F.lit(None)
    gender = F.coalesce(gender.cast("string"), F.lit(""))
    keys = F.array_sort(clean_conditions("required_conditions"))
    return criteria.select(
        "criteria_id",
        "age_min",
        "age_max",
        F.col("limit").alias("_limit"),
        keys.alias("required_conditions"),
        gender.alias("gender"),
        F.md5(F.concat_ws("\x1f", gender, keys)).alias("profile"),
    ).filter(F.col("age_min").isNotNull() & F.col("age_max").isNotNull())


def match_cohorts(
    patients: DataFrame,
    conditions: DataFrame,
    criteria: DataFrame,
    *,
    threshold: float = DEFAULT_THRESHOLD,
    **options,
) -> Cohorts:
    """Patients per criteria row: the first ``limit`` by patient_id, and how many in all.

    ``criteria``: criteria_id, age_min, age_max, required_conditions, limit and
    optionally gender. A limit of 0 or less gives no patients. Options are those of
    :func:`matchloom.operators.matching.eligible_patients`.

    Many criteria ask for the same conditions, most of all for none. Patients are matched
    once per distinct profile, and only their ages and ids are carried. Age ranges are
    then answered from sums and first members (:mod:`matchloom.operators.ageranges`), so the
    work does not grow with criteria times patients, nor times ages. Other fields are
    fetched for the patients found; ``patient_id`` is unique among ``patients``.
    """
    if "limit" not in criteria.columns:
        criteria = criteria.withColumn("limit", F.lit(DEFAULT_LIMIT))
    fields = options.pop("fields", PATIENT_FIELDS)
    asked = materialize(_profiled(criteria), "asked")
    facts = asked.agg(
        F.coalesce(F.max("_limit"), F.lit(0)).alias("widest"),
        F.coalesce(F.sum(F.greatest("_limit", F.lit(0)).cast("double")), F.lit(0.0)).alias("at_most"),
        F.count("*").alias("rows"),
    ).first()
    profiles = asked.groupBy(F.col("profile").alias("criteria_id")).agg(
        F.min("age_min").alias("age_min"),
        F.max("age_max").alias("age_max"),
        F.first("required_conditions").alias("required_conditions"),
        F.first("gender").alias("gender"),
    )
    eligible = eligible_patients(
        patients, conditions, profiles, threshold=threshold, fields=("age", "gender"), **options
    ).select(F.col("criteria_id").alias("profile"), "age", "patient_id")
    eligible = materialize(eligible, "eligible")

    ranges = asked.select("criteria_id", "profile", "age_min", "age_max", "_limit")
    # There are at most as many lists of ages as criteria.
    counts = count_in_ranges(ranges, eligible, steps_bounded=facts["rows"] <= STEP_LISTS)
    first = first_in_ranges(ranges.filter(F.col("_limit") > 0), eligible, facts["widest"])
    first = first.filter(F.col("rank") <= F.col("_limit")).select("criteria_id", "patient_id", "rank")
    first = materialize(first, "first")
    few = facts["at_most"] <= BROADCAST_ROWS
    public = patients.select("patient_id", *fields)
    matched = materialize(lookup_join(public, first, ["patient_id"], small_is_bounded=few), "matched")
    listed = count_conditions(
        candidate_conditions(conditions, first, patients_bounded=few)
    )
    return Cohorts(matched, listed, counts)


def find_eligible_patients(
    spark: SparkSession,
    patients: DataFrame,
    conditions: DataFrame,
    *,
    age_min: int,
    age_max: int,
    required_conditions: list[str] | None = None,
    limit: int = DEFAULT_LIMIT,
    gender: str | None = None,
    **options,
) -> DataFrame:
    """One request: patient rows with their ``conditions`` as (condition, n) arrays.

    A patient with an unusually long list comes in several rows, numbered ``page``.
    """
    row = (0, age_min, age_max, required_conditions or [], limit, gender)
    criteria = spark.createDataFrame(
        [row],
        "criteria_id int, age_min int, age_max int, required_conditions array<string>, "
        "limit int, gender string",
    )
    cohorts = match_cohorts(patients, conditions, criteria, **options)
    return with_conditions(cohorts).drop("criteria_id")


def with_conditions(cohorts: Cohorts) -> DataFrame:
    """Matched patients with nested conditions; no condition gives an empty array."""
    nested = nest_conditions(cohorts.conditions)
    empty = F.array().cast(nested.schema["conditions"].dataType)
    return (
        cohorts.matched.join(nested, "patient_id", "left")
        .withColumn("page", F.coalesce("page", F.lit(0)))
        .withColumn("conditions", F.coalesce("conditions", empty))
    )


def demographics(cohorts: Cohorts) -> tuple[DataFrame, DataFrame]:
    """Age summary and category counts per criteria row."""
    by = ["criteria_id"]
    return age_summary(cohorts.matched, by), category_counts(cohorts.matched, by)
