"""Matching people to criteria by age and by meaning of their conditions.

Patients are never compared with requirements. The distinct required strings are
compared with the distinct condition strings of the population. The resulting pairs
turn each patient's rows into the set of requirements that patient meets, in one
shuffle, and criteria look up candidates by their rarest requirement: in tasks over blocks
of patients where criteria and pairs are few, else by joins.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions.text import clean_conditions, normalize_key
from matchloom.operators.cache import EmbeddingCache, embed_cached
from matchloom.operators.embedding import TOLERATED, Embedder, distinct_keys
from matchloom.operators.scale import BROADCAST_ROWS, SPREAD_ROWS, is_small, lookup_join
from matchloom.operators.similarity import pairs_at_least
from matchloom.storage import materialize

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULT_THRESHOLD = 0.75
# Patients per task that tests them, and (patient, requirement) or (patient, anchor) cells it
# holds at a time.
MATCH_ROWS = 100_000
MATCH_CELLS = 1 << 19

# Public fields of a patient hit; marital status, ssn and address stay behind.
PATIENT_FIELDS = ("age", "gender", "race", "ethnicity", "name")


def age_between(low, high) -> Column:
    """Inclusive at both ends."""
    return F.col("age").between(low, high)


def candidate_conditions(
    conditions: DataFrame, patients: DataFrame, *, patients_bounded: bool = False
) -> DataFrame:
    """Condition rows of the given patients; no id list passes through the driver."""
    ids = patients.select("patient_id").distinct()
    return lookup_join(
        conditions, ids, ["patient_id"], how="left_semi", small_is_bounded=patients_bounded
    )


def count_conditions(conditions: DataFrame) -> DataFrame:
    """(patient_id, condition, n): each patient's condition list as a multiset."""
    return conditions.groupBy("patient_id", F.col("conditions").alias("condition")).agg(
        F.count("*").alias("n")
    )


def nest_conditions(
    counted: DataFrame, *, slots: int = 64, slot_rows: int = 1024
) -> DataFrame:
    """(patient_id, page, conditions): condition lists as arrays of (condition, n).

    Nearly every patient has page 0 only. A patient's conditions are first collected
    in ``slots`` hash slots; slots above ``slot_rows`` become pages of their own, so
    a patient owning a huge share of the rows never becomes one array.
    """
    slot = F.pmod(F.xxhash64("condition"), F.lit(slots)).cast("int")
    in_slots = counted.groupBy("patient_id", slot.alias("_slot")).agg(
        F.collect_list(F.struct("condition", "n")).alias("_part")
    )
    page = F.when(F.size("_part") > slot_rows, F.col("_slot") + 1).otherwise(0)
    return in_slots.groupBy("patient_id", page.alias("page")).agg(
        F.array_sort(F.flatten(F.collect_list("_part"))).alias("conditions")
    )


def requirements(criteria: DataFrame) -> DataFrame:
    """(criteria_id, bit, req_key) for every distinct non-blank requirement."""
    return criteria.select(
        "criteria_id",
        F.posexplode(clean_conditions("required_conditions")).alias("bit", "req_key"),
    )


def semantic_pairs(
    required: DataFrame,
    vocabulary: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    *,
    required_at_most: int | None = None,
) -> DataFrame:
    """(req_key, cond_key, similarity) of all pairs with similarity >= threshold.

    Both tables are (key, embedding) with distinct keys.
    """
    return pairs_at_least(
        vocabulary,
        required,
        threshold,
        left_id="key",
        right_id="key",
        out_left="cond_key",
        out_right="req_key",
        right_at_most=required_at_most,
    ).select("req_key", "cond_key", "similarity")


def _requirement_code(required: DataFrame) -> Callable[[Column | str], Column]:
    """How a requirement is written in sets: its 64-bit hash, which is quick to
    intersect, or the key itself in the unlikely case that two keys share a hash."""
    keys, codes = required.agg(
        F.count_distinct("req_key"), F.count_distinct(F.xxhash64("req_key"))
    ).first()
    if keys == codes:
        return F.xxhash64
    return lambda key: F.col(key) if isinstance(key, str) else key


def met_requirements(
    conditions: DataFrame,
    pairs: DataFrame,
    *,
    pairs_bounded: bool,
    code: Callable[[Column | str], Column],
) -> DataFrame:
    """(patient_id, met): the requirements each patient has a matching condition for.

    The set is at most as large as the list of distinct requirements, and rows of one
    patient or one condition collapse in the map tasks before the shuffle.
    """
    keyed = conditions.select("patient_id", normalize_key("conditions").alias("cond_key"))
    coded = pairs.select("cond_key", code("req_key").alias("req"))
    matched = lookup_join(keyed, coded, ["cond_key"], small_is_bounded=pairs_bounded)
    return matched.groupBy("patient_id").agg(F.collect_set("req").alias("met"))


def sorted_wanted(
    criteria: DataFrame,
    required: DataFrame,
    frequency: DataFrame,
    code: Callable[[Column | str], Column],
) -> DataFrame:
    """Criteria with ``wanted``: their requirements, rarest first."""
    sorted_keys = (
        required.join(frequency, "req_key", "left")
        .groupBy("criteria_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "req_key"))
            ).alias("_sorted")
        )
        .select("criteria_id", F.transform("_sorted", lambda s: code(s["req_key"])).alias("wanted"))
    )
    return criteria.join(sorted_keys, "criteria_id")


def anchored(criteria: DataFrame) -> DataFrame:
    """Criteria once per ``anchor``: a requirement by which candidates are looked up.

    To meet n of m requirements a patient must meet one of any m - n + 1 of them. The
    rarest are taken, so a condition that many people have is seldom an anchor.
    ``criteria`` has ``n_required`` and ``wanted`` (rarest first).
    """
    n_anchors = F.size("wanted") - F.col("n_required") + 1
    return criteria.withColumn("anchor", F.explode(F.slice("wanted", F.lit(1), n_anchors)))


class _Wanted(NamedTuple):
    """Criteria as arrays that travel with the task function; requirements are numbered."""

    columns: pa.RecordBatch  # what a match takes from its criteria row
    age_min: np.ndarray
    age_max: np.ndarray
    n_required: np.ndarray
    every: np.ndarray  # are all required?
    keys: np.ndarray  # (criteria row, place): distinct requirements, rarest first, then -1
    anchor_first: np.ndarray  # where the rows of each requirement's anchors begin
    anchor_row: np.ndarray
    meets_first: np.ndarray  # where the requirements that each condition meets begin
    meets: np.ndarray


def _wanted(criteria: pa.Table, meets: list[tuple[int, str]], n_conditions: int) -> _Wanted:
    """``criteria`` with wanted; ``meets`` are (number of a condition, requirement)."""
    lists = criteria["wanted"].to_pylist()
    number = {key: i for i, key in enumerate(dict.fromkeys(k for row in lists for k in row))}
    keys = np.full((len(lists), max((len(x) for x in lists), default=0)), -1, np.int64)
    n_required = criteria["n_required"].to_numpy().astype(np.int64)
    anchors = []
    for i, row in enumerate(lists):
        coded = [number[k] for k in row]
        distinct = list(dict.fromkeys(coded))
        keys[i, : len(distinct)] = distinct
        anchors += [(key, i) for key in coded[: len(row) - n_required[i] + 1]]
    anchors = np.array(sorted(anchors), np.int64).reshape(-1, 2)
    found = np.array(sorted((c, number[k]) for c, k in meets if k in number), np.int64).reshape(-1, 2)
    taken = criteria.drop_columns(["age_min", "age_max", "n_required", "wanted"]).combine_chunks()
    batches = taken.to_batches() or [pa.RecordBatch.from_pylist([], schema=taken.schema)]
    return _Wanted(
        batches[0],
        criteria["age_min"].to_numpy(), criteria["age_max"].to_numpy(), n_required,
        n_required == np.array([len(x) for x in lists], np.int64), keys,
        np.searchsorted(anchors[:, 0], np.arange(len(number) + 1)), anchors[:, 1],
        np.searchsorted(found[:, 0], np.arange(n_conditions + 1)), found[:, 1],
    )


def _expanded(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``first[i]`` to ``first[i + 1]`` for every i of ``at``, and how many each has."""
    size = first[at + 1] - first[at]
    return np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), size


def _matches(wanted: _Wanted, has: pa.ListArray, age: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(patient, criteria row) of all matches of a block of patients."""
    n, n_keys = len(has), len(wanted.anchor_first) - 1
    length = pa.compute.list_value_length(has).to_numpy(zero_copy_only=False).astype(np.int64)
    place, size = _expanded(wanted.meets_first, has.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    met = np.zeros(n * n_keys, bool)
    met[np.repeat(np.repeat(np.arange(n), length), size) * n_keys + wanted.meets[place]] = True
    known = age.is_valid().to_numpy(zero_copy_only=False)
    years = age.fill_null(0).to_numpy(zero_copy_only=False)
    patient, key = np.nonzero(met.reshape(n, n_keys) & known[:, None])
    place, size = _expanded(wanted.anchor_first, key)
    patient, key, row = np.repeat(patient, size), np.repeat(key, size), wanted.anchor_row[place]
    kept = (years[patient] >= wanted.age_min[row]) & (years[patient] <= wanted.age_max[row])
    patient, key, row = patient[kept], key[kept], row[kept]
    # Who must meet all has one anchor; the test ends at the first requirement not met.
    every = wanted.every[row]
    some, all_of = np.flatnonzero(~every), np.flatnonzero(every)
    for place in range(wanted.keys.shape[1]):
        asked = wanted.keys[row[all_of], place]
        all_of = all_of[(asked < 0) | met[patient[all_of] * n_keys + asked]]
    # A pair that several anchors find is kept at the first of them.
    count, first = np.zeros(len(some), np.int64), np.full(len(some), -1)
    for place in range(wanted.keys.shape[1] if len(some) else 0):
        asked = wanted.keys[row[some], place]
        held = (asked >= 0) & met[patient[some] * n_keys + asked]
        count += held
        first = np.where(held & (first < 0), asked, first)
    some = some[(count >= wanted.n_required[row[some]]) & (first == key[some])]
    chosen = np.concatenate([all_of, some])
    return patient[chosen], row[chosen]


def _matched_in_tasks(
    people: DataFrame, conditions: DataFrame, criteria: DataFrame, pairs: DataFrame
) -> DataFrame:
    """Columns of ``people`` and of ``criteria`` (with wanted) for every match.

    Criteria and pairs are few and travel with the task function. A patient's distinct
    conditions meet in one shuffle; the requirements they meet are looked up in the task,
    which tests a block of patients at a time.
    """
    spark = people.sparkSession
    found = pairs.select("cond_key", "req_key").toArrow()
    names = list(dict.fromkeys(found["cond_key"].to_pylist()))
    number = {name: i for i, name in enumerate(names)}
    asked = criteria.toArrow()
    wanted = _wanted(
        asked, [(number[c], r) for c, r in zip(*(found[x].to_pylist() for x in found.column_names))], len(names)
    )
    numbered = spark.createDataFrame(list(number.items()), "cond_key string, _condition int")
    keyed = conditions.select("patient_id", normalize_key("conditions").alias("cond_key"))
    has = (
        keyed.join(F.broadcast(numbered), "cond_key")
        .groupBy("patient_id").agg(F.collect_set("_condition").alias("_has"))
    )
    # Few bytes would be coalesced into one task, which then meets all criteria.
    tasks = max(spark.sparkContext.defaultParallelism, -(-people.count() // MATCH_ROWS))
    candidates = has.join(people, "patient_id").repartition(tasks, "patient_id", "age")
    candidates = candidates.select(*people.columns, "_has")
    kept = [c for c in criteria.columns if c in wanted.columns.schema.names]
    schema = T.StructType([people.schema[c] for c in people.columns] + [criteria.schema[c] for c in kept])
    block = max(1, MATCH_CELLS // max(1, len(wanted.anchor_first) - 1, len(wanted.anchor_row)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                patient, row = _matches(wanted, part.column("_has"), part.column("age"))
                columns = part.drop_columns(["_has"]).take(pa.array(patient)).columns
                columns += wanted.columns.take(pa.array(row)).columns
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return candidates.mapInArrow(match, schema)


def _strict_matches(
    people: DataFrame,
    conditions: DataFrame,
    criteria: DataFrame,
    needed: Column,
    *,
    threshold: float,
    embedder: Embedder | None,
    vocabulary: DataFrame | None,
    n_criteria: int,
    widest: int,
    tolerate: tuple[type[BaseException], ...],
    quarantine: str | None,
    cache: EmbeddingCache | None,
) -> DataFrame:
    required = requirements(criteria)
    distinct = required.select(F.col("req_key").alias("key")).distinct()
    req_vectors = embed_cached(distinct, "key", cache, embedder=embedder, tolerate=tolerate)
    if vocabulary is None:
        keys = distinct_keys(conditions, "conditions")
        vocabulary = embed_cached(keys, "key", cache, embedder=embedder, tolerate=tolerate)
    # Embedding may be a model call; both results are written so that it runs once.
    vocabulary = materialize(vocabulary, "vocabulary")
    req_vectors = materialize(req_vectors, "required")
    _report_failures({"condition": vocabulary, "requirement": req_vectors}, quarantine)
    pairs = semantic_pairs(
        req_vectors, vocabulary, threshold, required_at_most=n_criteria * widest
    )
    pairs = materialize(pairs, "semantic_pairs")

    counts = vocabulary.select(F.col("key").alias("cond_key"), "n")
    frequency = pairs.join(counts, "cond_key").groupBy("req_key").agg(F.sum("n").alias("rows"))
    sized = criteria.withColumn("n_required", needed.cast("int")).drop("required_conditions")
    bounded, few = is_small(pairs), n_criteria * widest <= BROADCAST_ROWS
    if bounded and few:
        plain = sorted_wanted(sized, required, frequency, lambda key: key)
        return _matched_in_tasks(people, conditions, plain, pairs)
    code = _requirement_code(required)
    wanted = materialize(anchored(sorted_wanted(sized, required, frequency, code)), "wanted")

    met = met_requirements(conditions, pairs, pairs_bounded=bounded, code=code)
    # One row per patient on both sides; the met sets are already laid out by patient.
    candidates = met.join(people, "patient_id")
    if is_small(people, SPREAD_ROWS):
        # Few bytes would be coalesced into one task, which then meets all criteria.
        cores = people.sparkSession.sparkContext.defaultParallelism
        candidates = candidates.repartition(cores, "patient_id", "age")
    candidates = candidates.withColumn("anchor", F.explode("met"))
    # There are no more anchors than requirements.
    few = few or is_small(wanted)
    candidates = lookup_join(
        candidates, wanted, ["anchor"], small_is_bounded=few
    ).filter(age_between(F.col("age_min"), F.col("age_max")))
    # A pair that several anchors find is kept at the first of them.
    first = F.transform(
        F.array(F.array_intersect("wanted", "met")),
        lambda both: (F.size(both) >= F.col("n_required"))
        & (F.get(both, F.lit(0)) == F.col("anchor")),
    )
    # Who must meet all has one anchor; the test ends at the first requirement not met.
    every = F.forall("wanted", lambda key: F.array_contains("met", key))
    is_met = F.when(F.col("n_required") == F.size("wanted"), every).otherwise(F.get(first, F.lit(0)))
    return candidates.filter(is_met)


def _report_failures(embedded: dict[str, DataFrame], quarantine: str | None) -> None:
    """Strings without a vector match nothing, so they are never passed over in silence:
    they are added to the table ``quarantine``, or the job fails where there is none."""
    parts = [
        df.filter(F.col("error").isNotNull()).select(F.lit(role).alias("role"), "key", "error")
        for role, df in embedded.items()
        if "error" in df.columns
    ]
    if not parts:
        return
    failed = reduce(DataFrame.unionByName, parts)
    if quarantine is not None:
        failed.write.mode("append").parquet(quarantine)
        return
    # One pass; taking rows would start a job for each few files of a clean table.
    first = failed.agg(F.min(F.struct("role", "key", "error"))).first()[0]
    if first:
        raise ValueError(f"no vectors for some strings, such as {tuple(first)}")


def by_age(criteria: DataFrame, people: DataFrame) -> DataFrame:
    """Criteria once per age in their range that occurs among ``people``.

    Ages are a small domain; a range join becomes an equality on ``age``.
    """
    ages = people.agg(F.collect_set("age")).scalar()
    return (
        criteria.withColumn("age", ages)
        .withColumn("age", F.explode("age"))
        .filter(age_between(F.col("age_min"), F.col("age_max")))
    )


def _free_matches(people: DataFrame, criteria: DataFrame) -> DataFrame:
    """Criteria without requirements: everyone in the age range."""
    ages = by_age(criteria.drop("required_conditions"), people)
    return lookup_join(people, ages, ["age"], small_is_bounded=is_small(ages))


def eligible_patients(
    patients: DataFrame,
    conditions: DataFrame,
    criteria: DataFrame,
    *,
    threshold: float = DEFAULT_THRESHOLD,
    embedder: Embedder | None = None,
    vocabulary: DataFrame | None = None,
    require: str = "all",
    min_match: int | None = None,
    fields: Sequence[str] = PATIENT_FIELDS,
    tolerate: tuple[type[BaseException], ...] = TOLERATED,
    quarantine: str | None = None,
    cache: EmbeddingCache | None = None,
) -> DataFrame:
    """(criteria_id, patient_id, *fields): everyone who meets each criteria row.

    ``criteria``: criteria_id, age_min, age_max, required_conditions, optionally
    gender; rows with an unknown age bound match nobody. Criteria are requests and
    are counted here; patients and conditions may be of any size. ``require='any'``
    or ``min_match`` relax how many requirements must be met. ``vocabulary`` is a
    stored (key, n, embedding) table of the condition strings, if there is one. Strings
    on which the model raises one of ``tolerate`` go to the table at ``quarantine``; the
    call fails if there are any and no such table. With a ``cache`` the model sees only
    strings whose vectors it does not hold.
    """
    kept = ["criteria_id", "age_min", "age_max", "required_conditions"]
    known = criteria
    if "gender" in criteria.columns:
        known = known.withColumn("_gender", F.col("gender"))
        kept.append("_gender")
    known = known.filter(F.col("age_min").isNotNull() & F.col("age_max").isNotNull())
    known = known.select(*kept)
    size = F.size(clean_conditions("required_conditions"))
    facts = known.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.max(size), F.lit(0)).alias("widest"),
        F.count_if(size == 0).alias("free"),
        F.min("age_min").alias("low"),
        F.max("age_max").alias("high"),
    ).first()
    # One age window around all criteria reaches the file scan.
    people = patients.select("patient_id", *fields)
    people = people.filter(age_between(facts["low"], facts["high"]))

    found = []
    if facts["rows"] > facts["free"]:
        needed = {"all": size, "any": F.lit(1)}[require]
        if min_match is not None:
            needed = F.least(size, F.lit(max(1, min_match)))
        found.append(
            _strict_matches(
                people,
                conditions,
                known.filter(size > 0),
                needed,
                threshold=threshold,
                embedder=embedder,
                vocabulary=vocabulary,
                n_criteria=facts["rows"],
                widest=facts["widest"],
                tolerate=tolerate,
                quarantine=quarantine,
                cache=cache,
            )
        )
    if facts["free"] or not found:
        found.append(_free_matches(people, known.filter(size == 0)))
    if "_gender" in kept:
        off = F.col("_gender").isNull() | (F.col("_gender") == "")
        found = [f.filter(off | (F.col("gender") == F.col("_gender"))) for f in found]
    found = [f.select("criteria_id", "patient_id", *fields) for f in found]
    return reduce(DataFrame.unionByName, found)
