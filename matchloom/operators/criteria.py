"""Criteria inferred from retrieved trials, and recruitment feasibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import lenient_int, parse_conditions

# Fixed value: patient limit when no trial states an enrollment.
DEFAULT_PATIENT_LIMIT = 100
DEFAULT_MAX_PATIENTS = 200
# Availability ratio bounds, tested on the unrounded ratio.
LEVELS = ((1.5, "HIGH"), (1.0, "MEDIUM"), (None, "LOW"))
RISKS = ((2.0, "Minimal"), (1.2, "Moderate"), (None, "High"))
# Fixed value: how many conditions the summary sentence names.
NAMED_CONDITIONS = 5


def unique_conditions(hits: DataFrame, *, exact: str | None = None) -> DataFrame:
    """(query_id, conditions): distinct names in order of first appearance.

    Order is by hit rank, then by place in the trial's list; names are compared as
    they are. ``exact`` names an array column to use instead of splitting the
    comma-joined text.
    """
    names = F.col(exact) if exact else parse_conditions("conditions")
    first = (
        hits.select("query_id", "rank", F.posexplode(names).alias("pos", "name"))
        .groupBy("query_id", "name")
        .agg(F.min(F.struct("rank", "pos")).alias("at"))
    )
    return first.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]
        ).alias("conditions")
    )


def patient_limit(median_enrollment: Column, max_patients: Column | int) -> Column:
    cap = F.lit(max_patients) if isinstance(max_patients, int) else max_patients
    wanted = F.coalesce(_truncated(median_enrollment), F.lit(DEFAULT_PATIENT_LIMIT).cast("bigint"))
    return F.least(wanted, cap.cast("bigint"))


def _truncated(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("bigint")


def infer_criteria(
    hits: DataFrame,
    *,
    max_patients: Column | int = DEFAULT_MAX_PATIENTS,
    exact_conditions: str | None = None,
) -> DataFrame:
    """One criteria row per query that has hits.

    query_id, n_trials, conditions, median_min_age, median_max_age,
    median_enrollment, patient_limit, age_min, age_max, and n_min_age, n_max_age,
    n_enrollment: how many numbers each median is over. Without any it is NULL.
    """
    min_age, max_age = lenient_int("minimum_age"), lenient_int("maximum_age")
    enrollment = lenient_int("enrollment")
    medians = hits.groupBy("query_id").agg(
        F.count("*").alias("n_trials"),
        F.median(min_age).alias("median_min_age"),
        F.median(max_age).alias("median_max_age"),
        F.median(enrollment).alias("median_enrollment"),
        F.count(min_age).alias("n_min_age"),
        F.count(max_age).alias("n_max_age"),
        F.count(enrollment).alias("n_enrollment"),
    )
    conditions = unique_conditions(hits, exact=exact_conditions)
    return (
        medians.join(conditions, "query_id", "left")
        .withColumn("conditions", F.coalesce("conditions", F.array().cast("array<string>")))
        .withColumn("patient_limit", patient_limit(F.col("median_enrollment"), max_patients))
        .withColumn("age_min", _truncated(F.col("median_min_age")).cast("int"))
        .withColumn("age_max", _truncated(F.col("median_max_age")).cast("int"))
    )


def _graded(ratio: Column, grades) -> Column:
    result = None
    for bound, name in grades:
        if bound is None:
            return result.otherwise(name)
        result = F.when(ratio >= bound, name) if result is None else result.when(ratio >= bound, name)
    return result


def feasibility(df: DataFrame, *, population: str = "eligible", ages_known: Column | None = None):
    """Adds feasibility columns to rows with median_enrollment, patient_limit and the
    number of eligible patients in column ``population``.

    Two readings side by side. ``capped_*`` counts patients only up to the limit, so
    its ratio cannot exceed 1 unless the median is below 1. ``population_*`` counts
    everyone eligible. Where ``ages_known`` is false all columns are NULL.
    """
    known = F.lit(True) if ages_known is None else ages_known
    limit = F.col("patient_limit").cast("double")
    median = F.col("median_enrollment").cast("double")
    target = F.coalesce(F.nullif(median, F.lit(0.0)), limit)
    everyone = F.coalesce(F.col(population), F.lit(0)).cast("bigint")
    capped = F.greatest(F.least(everyone, F.col("patient_limit").cast("bigint")), F.lit(0))
    out = {"target_enrollment": F.when(known, target)}
    for name, available in (("capped", capped), ("population", everyone)):
        ratio = F.when(target > 0, available / F.nullif(target, F.lit(0.0))).otherwise(0.0)
        out[f"{name}_available"] = F.when(known, available.cast("bigint"))
        out[f"{name}_ratio"] = F.when(known, F.round(ratio, 2))
        out[f"{name}_level"] = F.when(known, _graded(ratio, LEVELS))
        out[f"{name}_risk"] = F.when(known, _graded(ratio, RISKS))
    return df.withColumns(out)


def _printed_median(name: str) -> Column:
    """A median of integers as text: ``20`` over an odd, ``20.0`` over an even count."""
    value = F.col(f"median_{name}")
    odd = F.col(f"n_{name}") % 2 == 1
    return F.when(odd, F.format_string("%d", value.cast("bigint"))).when(
        value.isNotNull(), F.format_string("%.1f", value)
    )


def summary_sentence(matched: Column, level: Column) -> Column:
    """One sentence per query from the columns of :func:`infer_criteria`."""
    names = F.col("conditions")
    n = F.size(names)
    more = F.when(n > NAMED_CONDITIONS, "...").otherwise("")
    unknown = F.lit("None")
    target = F.when(F.col("median_enrollment") != 0, _printed_median("enrollment"))
    # Fixed value: the sentence format.
    return F.concat(
        F.lit("Found "),
        F.col("n_trials").cast("string"),
        F.lit(" similar trials. Inferred "),
        n.cast("string"),
        F.lit(" unique conditions: "),
        F.array_join(F.slice(names, 1, NAMED_CONDITIONS), ", "),
        more,
        F.lit(". Age range: "),
        F.coalesce(_printed_median("min_age"), unknown),
        F.lit("–"),
        F.coalesce(_printed_median("max_age"), unknown),
        F.lit(". Target enrollment: "),
        F.coalesce(target, F.lit("N/A")),
        F.lit(". Matched "),
        F.coalesce(matched, F.lit(0)).cast("string"),
        F.lit(" patients (feasibility: "),
        F.coalesce(level, F.lit("UNKNOWN")),
        F.lit(")."),
    )
