"""The plain relational questions users ask of the three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.scale import lookup_join


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with this key; the predicate reaches the file scan."""
    return df.filter(F.col(key) == value)


def conditions_of(conditions: DataFrame, patient_id) -> DataFrame:
    return lookup(conditions, "patient_id", patient_id).select("conditions")


def trials_with_condition(trials: DataFrame, part: str) -> DataFrame:
    """Case-sensitive substring search in the conditions text."""
    return trials.filter(F.contains("conditions", F.lit(part))).select("nct_id", "conditions")


def patients_with_conditions(
    patients: DataFrame, conditions: DataFrame, *, how: str = "left"
) -> DataFrame:
    """One row per patient and condition row.

    ``how='left'`` keeps patients without conditions. The condition table is the
    large side and one patient may own much of it, so it is joined as the big side
    whose hot keys stay in place, and the patients nobody refers to are added afterwards.
    """
    people = patients.select("patient_id", "name", "age")
    rows = conditions.select("patient_id", "conditions")
    joined = lookup_join(rows, people, ["patient_id"], small_is_bounded=False)
    columns = ["patient_id", "name", "age", "conditions"]
    if how == "inner":
        return joined.select(*columns)
    owners = rows.select("patient_id").distinct()
    alone = people.join(owners, "patient_id", "left_anti").withColumn(
        "conditions", F.lit(None).cast("string")
    )
    return joined.select(*columns).unionByName(alone.select(*columns))


def page(df: DataFrame, order: str, *, offset: int, limit: int) -> DataFrame:
    """``limit`` rows after the first ``offset`` in the given order."""
    return df.orderBy(order).offset(offset).limit(limit)


def by_ids(table: DataFrame, ids: DataFrame, key: str, *, ids_bounded: bool) -> DataFrame:
    """Rows whose key is in the id table."""
    return lookup_join(
        table, ids.select(key).distinct(), [key], how="left_semi", small_is_bounded=ids_bounded
    )
