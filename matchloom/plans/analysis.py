"""From a search query to inferred criteria, a matched cohort and feasibility."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.criteria import (
    DEFAULT_MAX_PATIENTS,
    feasibility,
    infer_criteria,
    patient_limit,
    summary_sentence,
)
from matchloom.operators.embedding import Embedder
from matchloom.operators.matching import DEFAULT_THRESHOLD
from matchloom.plans.cohort import Cohorts, demographics, match_cohorts
from matchloom.plans.search import SearchIndex, search_trials
from matchloom.storage import materialize


class Analysis(NamedTuple):
    summary: DataFrame  # one row per query
    similar_trials: DataFrame  # one row per (query, trial)
    cohorts: Cohorts  # criteria_id is the query_id
    age: DataFrame
    categories: DataFrame


def analyze_and_match(
    index: SearchIndex,
    patients: DataFrame,
    conditions: DataFrame,
    requests: DataFrame,
    *,
    top_k_trials: int = 5,
    max_patients: int = DEFAULT_MAX_PATIENTS,
    threshold: float = DEFAULT_THRESHOLD,
    embedder: Embedder | None = None,
    **options,
) -> Analysis:
    """Analyse every request (query_id, query) in one set of jobs.

    The two small tables between the stages (trial hits, criteria) are written, so
    each stage runs once and its size is known to the next.
    """
    hits = search_trials(
        index, requests.select("query_id", "query"), top_k=top_k_trials, embedder=embedder
    )
    hits = materialize(hits, "similar_trials")
    criteria = materialize(infer_criteria(hits, max_patients=max_patients), "criteria")
    cohorts = match_cohorts(
        patients,
        conditions,
        criteria.select(
            F.col("query_id").alias("criteria_id"),
            "age_min",
            "age_max",
            F.col("conditions").alias("required_conditions"),
            F.col("patient_limit").alias("limit"),
        ),
        threshold=threshold,
        embedder=embedder,
        **options,
    )
    age, categories = demographics(cohorts)
    summary = summarize(requests, criteria, cohorts, age, max_patients=max_patients)
    return Analysis(summary, hits, cohorts, age, categories)


def summarize(
    requests: DataFrame,
    criteria: DataFrame,
    cohorts: Cohorts,
    age: DataFrame,
    *,
    max_patients: int = DEFAULT_MAX_PATIENTS,
) -> DataFrame:
    """One row per request; feasibility and demographics are NULL for unknown ages."""
    known = F.col("age_min").isNotNull() & F.col("age_max").isNotNull()
    counts = cohorts.eligible_counts.withColumnRenamed("criteria_id", "query_id")
    ages = age.select(
        F.col("criteria_id").alias("query_id"),
        F.col("age_min").alias("patients_age_min"),
        F.col("age_max").alias("patients_age_max"),
        F.col("age_median").alias("patients_age_median"),
        F.col("age_mean").alias("patients_age_mean"),
    )
    joined = (
        requests.select("query_id", "query")
        .join(criteria, "query_id", "left")
        .join(counts, "query_id", "left")
        .join(ages, "query_id", "left")
    )
    # A query without hits: no medians, and the default limit.
    joined = joined.withColumns(
        {
            "n_trials": F.coalesce("n_trials", F.lit(0).cast("bigint")),
            "conditions": F.coalesce("conditions", F.array().cast("array<string>")),
            "patient_limit": F.coalesce(
                "patient_limit", patient_limit(F.lit(None).cast("double"), max_patients)
            ),
        }
    )
    graded = feasibility(joined, ages_known=known)
    return graded.withColumn(
        "content", summary_sentence(F.col("capped_available"), F.col("capped_level"))
    )
