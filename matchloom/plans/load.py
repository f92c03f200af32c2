"""The whole load: people, their conditions and the studies, with rules and counts."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame

from matchloom.operators.quality import (
    dedupe_rows,
    keep_first_by_key,
    load_report,
    split_by_parent,
    split_nulls,
)
from matchloom.sources.tables import CONDITIONS_COLUMNS, DEMOGRAPHICS_COLUMNS, clean_demographics
from matchloom.storage import materialize

TRIAL_COLUMNS = ("nct_id", "text")


class Loaded(NamedTuple):
    people: DataFrame
    conditions: DataFrame
    trials: DataFrame
    reports: DataFrame  # table_name, rows_read, added, skipped, not_found


def load_all(demographics: DataFrame, conditions: DataFrame, trials: DataFrame) -> Loaded:
    """Clean the three tables and count what each rule did.

    ``demographics`` comes from ``load_demographics(file_order=True)``, ``conditions``
    from ``load_conditions`` and ``trials`` from ``trial_table``. People: equal rows
    once, all columns present, the first row of an id. Conditions: of people who were
    kept, both columns present, repeated rows kept. Studies: text present, one per id.
    """
    people = materialize(clean_demographics(demographics), "people")
    owned = split_by_parent(conditions, people, "patient_id").good
    kept = split_nulls(owned, CONDITIONS_COLUMNS).good
    whole = split_nulls(trials, TRIAL_COLUMNS).good
    studies = keep_first_by_key(whole, ["nct_id"], ["text"])
    reports = [
        load_report(
            "demographics", dedupe_rows(demographics.select(*DEMOGRAPHICS_COLUMNS)),
            required=DEMOGRAPHICS_COLUMNS, key="patient_id",
        ),
        load_report(
            "conditions", conditions, required=CONDITIONS_COLUMNS,
            parent=people, parent_key="patient_id",
        ),
        load_report("trials", trials, required=TRIAL_COLUMNS, key="nct_id"),
    ]
    return Loaded(people, kept, studies, reduce(DataFrame.unionByName, reports))
