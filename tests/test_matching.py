import random

import pytest
from pyspark.sql import functions as F

from matchloom import find_eligible_patients, match_cohorts
from matchloom.operators import criteria, matching, retrieval

PEOPLE = "patient_id int, age int, gender string, race string, ethnicity string, name string"


@pytest.fixture(scope="module")
def people(spark):
    ages = [39, 40, 55, 70, 71, 50]
    return spark.createDataFrame(
        [(i, a, "FM"[i % 2], "r", "e", f"n{i}") for i, a in enumerate(ages)], PEOPLE
    )


@pytest.fixture(scope="module")
def conditions(spark):
    rows = [(1, "Asthma"), (1, "asthma "), (1, "type two diabetes"), (2, "asthma"), (3, "gout"),
            (3, " "), (4, "asthma"), (5, "type two diabetes"), (99, "asthma")]
    return spark.createDataFrame(rows, "patient_id int, conditions string")


def found(spark, people, conditions, required, **options):
    hits = find_eligible_patients(
        spark, people, conditions, age_min=40, age_max=70, required_conditions=required, **options
    )
    return sorted(r.patient_id for r in hits.collect())


def test_requirements(spark, people, conditions):
    assert found(spark, people, conditions, []) == [1, 2, 3, 5]
    assert found(spark, people, conditions, [" ", ""]) == [1, 2, 3, 5]
    assert found(spark, people, conditions, ["ASTHMA "]) == [1, 2]
    assert found(spark, people, conditions, ["asthma", "type two diabetes"]) == [1]
    assert found(spark, people, conditions, ["no such thing"]) == []
    assert found(spark, people, conditions, ["asthma", "gout"], require="any") == [1, 2, 3]
    three = ["asthma", "gout", "type two diabetes"]
    assert found(spark, people, conditions, three, min_match=2) == [1]


def test_limit_gender_and_threshold(spark, people, conditions):
    assert found(spark, people, conditions, [], limit=2) == [1, 2]
    assert found(spark, people, conditions, [], limit=0) == []
    assert found(spark, people, conditions, [], gender="F") == [2]
    # 'diabetes' and 'type two diabetes' share one of three words: 1 / sqrt(3).
    assert found(spark, people, conditions, ["diabetes"]) == []
    assert found(spark, people, conditions, ["diabetes"], threshold=0.57) == [1, 5]


def test_output_has_conditions_and_no_private_fields(spark, people, conditions):
    hits = find_eligible_patients(spark, people, conditions, age_min=0, age_max=99)
    assert not {"ssn", "address", "marital"} & set(hits.columns)
    by_id = {r.patient_id: r.conditions for r in hits.collect()}
    assert [(c.condition, c.n) for c in by_id[1]] == [
        ("Asthma", 1), ("asthma ", 1), ("type two diabetes", 1)]
    assert by_id[0] == []


def test_long_lists_come_in_pages_and_stay_whole(spark):
    counted = spark.range(5000).select(
        F.lit(1).alias("patient_id"), F.concat(F.lit("c"), "id").alias("condition"),
        F.lit(1).cast("bigint").alias("n"),
    )
    pages = matching.nest_conditions(counted, slots=8, slot_rows=100).collect()
    assert len(pages) == 8
    assert len({c.condition for p in pages for c in p.conditions}) == 5000


def test_many_criteria_equal_single_calls(spark, people, conditions):
    wanted = [(1, 40, 70, ["asthma"], 1), (2, 0, 99, [], 3), (3, 0, 99, ["asthma"], 10),
              (4, None, 99, [], 10), (5, 50, 60, ["gout"], 5), (6, 0, 99, ["Asthma"], 0)]
    table = spark.createDataFrame(
        wanted, "criteria_id int, age_min int, age_max int, required_conditions array<string>, limit int"
    )
    cohorts = match_cohorts(people, conditions, table)
    got = {}
    for r in cohorts.matched.orderBy("criteria_id", "rank").collect():
        got.setdefault(r.criteria_id, []).append(r.patient_id)
    assert got == {1: [1], 2: [0, 1, 2], 3: [1, 2, 4]}
    assert {r.criteria_id: r.eligible for r in cohorts.eligible_counts.collect()} == {
        1: 2, 2: 6, 3: 3, 6: 3}


def graded(spark, median, limit, eligible):
    df = spark.createDataFrame([(median, limit, eligible)],
                               "median_enrollment double, patient_limit bigint, eligible bigint")
    return criteria.feasibility(df).first()


def test_feasibility(spark):
    r = graded(spark, 80.0, 80, 134)
    assert (r.capped_available, r.capped_ratio, r.capped_level, r.capped_risk) == (80, 1.0, "MEDIUM", "High")
    assert (r.population_available, r.population_level, r.population_risk) == (134, "HIGH", "Moderate")
    r = graded(spark, 0.0, 0, 50)
    assert (r.target_enrollment, r.capped_ratio, r.capped_level, r.capped_risk) == (0.0, 0.0, "LOW", "High")
    r = graded(spark, None, 100, 40)
    assert (r.target_enrollment, r.capped_ratio, r.capped_level) == (100.0, 0.4, "LOW")
    r = graded(spark, 80.5, 80, 80)
    assert (r.target_enrollment, r.capped_ratio, r.capped_level) == (80.5, 0.99, "LOW")


HITS = "query_id int, rank int, conditions string, minimum_age string, maximum_age string, enrollment bigint"


def test_inferred_criteria(spark):
    hits = spark.createDataFrame(
        [(1, 1, "b, a", "18", "65", None), (1, 2, "a, c", "21", "NA", None), (1, 3, "A", "x", "", None),
         (2, 1, "", None, None, 80)], HITS)
    one, two = criteria.infer_criteria(hits).orderBy("query_id").collect()
    assert one.conditions == ["b", "a", "c", "A"]
    assert (one.median_min_age, one.median_max_age, one.median_enrollment) == (19.5, 65.0, None)
    assert (one.age_min, one.age_max, one.patient_limit) == (19, 65, 100)
    assert (two.conditions, two.age_min, two.patient_limit) == ([], None, 80)
    text = criteria.summary_sentence(F.lit(4), F.lit("LOW"))
    sentences = [r[0] for r in criteria.infer_criteria(hits).orderBy("query_id").select(text).collect()]
    assert sentences[0] == (
        "Found 3 similar trials. Inferred 4 unique conditions: b, a, c, A. Age range: 19.5–65. "
        "Target enrollment: N/A. Matched 4 patients (feasibility: LOW).")
    assert "Age range: None–None. Target enrollment: 80." in sentences[1]


def test_rrf(spark):
    def leg(*ids):
        return spark.createDataFrame([(1, c, n + 1) for n, c in enumerate(ids)],
                                     "query_id int, chunk_id string, rank int")

    got = retrieval.rrf_fuse(leg("A", "B", "C"), leg("C", "A", "D"), k=10).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 6)) for r in got] == [
        ("A", 0.032522), ("C", 0.032266), ("B", 0.016129), ("D", 0.015873)]
    other = retrieval.rrf_fuse(leg("C", "A", "D"), leg("A", "B", "C"), k=10).orderBy("rank").collect()
    assert got == other


def test_enrollment_filter(spark):
    df = spark.createDataFrame([(None,), (100,), (99,)], "enrollment bigint")
    assert df.filter(retrieval.min_enrollment_filter(0)).count() == 3
    assert df.filter(retrieval.min_enrollment_filter(100)).count() == 1


def test_missing_trial_is_flagged(spark):
    hits = spark.createDataFrame([(1, "N1"), (1, "N2")], "query_id int, nct_id string")
    trials = spark.createDataFrame([("N1", "t", "c")], "nct_id string, text string, conditions string")
    for bounded in (True, False):
        got = retrieval.enrich_trials(hits, trials, hits_bounded=bounded).orderBy("nct_id").collect()
        assert [(r.nct_id, r.full_text, r.missing_trial) for r in got] == [
            ("N1", "t", False), ("N2", None, True)]


@pytest.mark.parametrize("options", [{}, {"require": "any"}, {"min_match": 2}, {"threshold": 0.5, "min_match": 3}])
def test_few_criteria_are_tested_in_tasks(spark, monkeypatch, options):
    """The same matches as by joins, without a row per patient and requirement."""
    draw = random.Random(3)
    names = [f"{a} {b}" for a in ("red", "old", "hot") for b in ("bolt", "ring", "gear")]
    folk = [(i if i % 50 else None, draw.choice([None, *range(20, 60)]), draw.choice("FM")) for i in range(300)]
    folk += folk[:20]
    held = [(draw.randrange(320), draw.choice([*names, None, " ", "Red Bolt "])) for _ in range(1500)] + [(None, "red bolt")]
    asked = [
        (draw.choice([i, i, 1, None]), draw.randrange(15, 40), draw.choice([None, *range(30, 70)]),
         draw.sample([*names, "no such thing", "", "OLD ring"], draw.randrange(0, 5)), draw.choice(["F", "", None]))
        for i in range(60)
    ]
    tables = (
        spark.createDataFrame(folk, "patient_id int, age int, gender string").repartition(3),
        spark.createDataFrame(held, "patient_id int, conditions string"),
        spark.createDataFrame(
            asked, "criteria_id int, age_min int, age_max int, required_conditions array<string>, gender string"
        ),
    )

    def rows():
        hits = matching.eligible_patients(*tables, fields=("age", "gender"), **options)
        return sorted(map(tuple, hits.collect()), key=str)

    with monkeypatch.context() as patch:
        patch.setattr(matching, "BROADCAST_ROWS", 0)
        joined = rows()
    for name in ("met_requirements", "anchored"):
        monkeypatch.setattr(matching, name, None)
    for cells in (matching.MATCH_CELLS, 1):
        monkeypatch.setattr(matching, "MATCH_CELLS", cells)
        assert rows() == joined and len(joined) > 100
