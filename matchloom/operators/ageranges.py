"""Counts and first members of age ranges, for very many ranges over the same people.

Ranges never meet people, nor single ages. People of a profile are summed up twice:

* a sorted list of (age, number of people up to it), so a count is one difference;
* the first ``k`` people of dyadic blocks of ages (1, 2, 4, ... years wide). Any range is
  a union of at most two blocks per width, so it looks at a few blocks and not at each
  of its ages.

``people`` are rows of (profile, age, patient_id) and ``ranges`` of (criteria_id, profile,
age_min, age_max); ends are inclusive. People without an age are in no range, and a range
whose ends are null or crossed holds nobody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.scale import is_small, lookup_join, top_k_per_group, without_late_rows
from matchloom.storage import materialize

BLOCK = ["profile", "level", "block"]


def _upto(steps: Column, age: Column) -> Column:
    """People of at most ``age``, by the last step at or below it."""
    below = F.filter(steps, lambda s: s["age"] <= age)
    return F.coalesce(F.try_element_at(below, F.lit(-1))["upto"], F.lit(0))


def age_steps(people: DataFrame) -> DataFrame:
    """(profile, steps): ascending (age, upto), one per age that occurs."""
    counted = people.filter(F.col("age").isNotNull()).groupBy("profile", "age").agg(F.count("*").alias("n"))
    ordered = counted.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("age", "n"))).alias("_ages"))
    summed = F.aggregate(
        "_ages",
        F.array().cast("array<struct<age:bigint,upto:bigint>>"),
        lambda done, x: F.array_append(
            done,
            F.struct(
                x["age"].cast("bigint").alias("age"),
                (x["n"] + F.coalesce(F.try_element_at(done, F.lit(-1))["upto"], F.lit(0))).alias("upto"),
            ),
        ),
    )
    return ordered.select("profile", summed.alias("steps"))


def count_in_ranges(ranges: DataFrame, people: DataFrame, *, steps_bounded: bool) -> DataFrame:
    """(criteria_id, eligible) of the ranges that hold anyone."""
    ranges = ranges.filter(F.col("age_min") <= F.col("age_max"))
    found = lookup_join(ranges, age_steps(people), ["profile"], small_is_bounded=steps_bounded)
    n = _upto(F.col("steps"), F.col("age_max")) - _upto(F.col("steps"), F.col("age_min").cast("bigint") - 1)
    return found.select("criteria_id", n.alias("eligible")).filter(F.col("eligible") > 0)


def blocks_of(low: Column, high: Column, levels: int) -> Column:
    """The fewest dyadic blocks (level, block) that make up ``low`` to ``high``, both from 0.

    The two ends move up the widths; an end that does not begin or close a wider block
    gives its own. The widest blocks are taken as they are.
    """
    kind = "array<struct<level:int,block:bigint>>"
    state = F.struct(
        low.cast("bigint").alias("a"),
        (high.cast("bigint") + 1).alias("b"),
        F.array().cast(kind).alias("taken"),
    )

    def one(level: Column, block: Column) -> Column:
        return F.array(F.struct(level.cast("int").alias("level"), block.alias("block")))

    def step(s: Column, level: Column) -> Column:
        none = F.array().cast(kind)
        left = (s["a"] < s["b"]) & (s["a"] % 2 == 1)
        a = s["a"] + left.cast("bigint")
        right = (a < s["b"]) & (s["b"] % 2 == 1)
        b = s["b"] - right.cast("bigint")
        taken = F.concat(
            s["taken"],
            F.when(left, one(level, s["a"])).otherwise(none),
            F.when(right, one(level, b)).otherwise(none),
        )
        open_ = a < b
        return F.struct(
            F.when(open_, F.shiftright(a, 1)).otherwise(F.lit(0).cast("bigint")).alias("a"),
            F.when(open_, F.shiftright(b, 1)).otherwise(F.lit(0).cast("bigint")).alias("b"),
            taken.alias("taken"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), state, step)["taken"]


def first_in_blocks(people: DataFrame, k: int, base: int, levels: int) -> DataFrame:
    """(profile, level, block, patient_id, age): the first ``k`` people of every block.

    People are cut to ``k`` per age before they are copied to the wider blocks; most of those
    who are far behind go before they are sorted.
    """
    order = [F.col("patient_id")]
    people = without_late_rows(people, ["profile", "age"], "patient_id", k)
    by_age = top_k_per_group(people, ["profile", "age"], order, k, rank="_first", salt_by=["patient_id"])
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    copied = by_age.select("profile", "age", "patient_id", level).withColumn(
        "block", F.expr(f"shiftright(CAST(age AS BIGINT) - {base}L, level)")
    )
    return top_k_per_group(copied, BLOCK, order, k, rank="_first", salt_by=["patient_id"]).drop("_first")


def first_in_ranges(ranges: DataFrame, people: DataFrame, k: int) -> DataFrame:
    """(criteria_id, patient_id, age, rank, and the other columns of ``ranges``): the first
    ``k`` people of every range by patient_id."""
    facts = people.agg(F.min("age").alias("low"), F.max("age").alias("high")).first()
    base, top = facts["low"] or 0, facts["high"] or 0
    levels = (top - base + 1).bit_length()
    low, high = F.greatest("age_min", F.lit(base)) - base, F.least("age_max", F.lit(top)) - base
    asked = ranges.filter(F.col("age_min") <= F.col("age_max")).filter(low <= high)
    pieces = asked.withColumn("_piece", F.explode(blocks_of(low, high, levels))).withColumns(
        {"level": F.col("_piece.level"), "block": F.col("_piece.block")}
    )
    # At most k rows a block: few, however many people there are.
    blocks = materialize(first_in_blocks(people.filter(F.col("age").isNotNull()), k, base, levels), "blocks")
    found = lookup_join(
        pieces.drop("_piece", "age_min", "age_max"), blocks, BLOCK, small_is_bounded=is_small(blocks)
    ).drop(*BLOCK)
    return top_k_per_group(found, ["criteria_id"], [F.col("patient_id")], k, salt_by=["patient_id"])
