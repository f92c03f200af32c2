"""Age ranges answered from sums and dyadic blocks, against a scan of everyone."""

import random

import pytest

from matchloom.operators import scale
from matchloom.operators.ageranges import count_in_ranges, first_in_ranges


def _tables(spark, ages):
    draw = random.Random(5)
    people = [(draw.choice("abc"), draw.choice(ages), i) for i in range(400)] + [("a", None, 900)]
    # One profile holds a third of all ranges; some are crossed, empty or far outside.
    ranges = [
        (i, "a" if i % 3 else draw.choice("bcx"), draw.choice(ages) - draw.randrange(4), draw.choice(ages) + draw.randrange(4))
        for i in range(120)
    ] + [(500, "a", -(10**6), 10**6), (501, "b", None, 5), (502, "c", 5, None)]
    return (
        people, ranges,
        spark.createDataFrame(people, "profile string, age int, patient_id bigint"),
        spark.createDataFrame(ranges, "criteria_id int, profile string, age_min int, age_max int"),
    )


@pytest.mark.parametrize("ages", [range(0, 130), [7], range(-40, 300, 17)])
@pytest.mark.parametrize("bounded", [True, False])
def test_ranges_against_a_scan(spark, ages, bounded):
    people, ranges, folk, asked = _tables(spark, list(ages))
    inside = {
        c: sorted(p for q, age, p in people if q == profile and age is not None and low <= age <= high)
        for c, profile, low, high in ranges if low is not None and high is not None
    }
    counts = {r["criteria_id"]: r["eligible"] for r in count_in_ranges(asked, folk, steps_bounded=bounded).collect()}
    assert counts == {c: len(p) for c, p in inside.items() if p}
    for k in (1, 5, 2000):
        found = {}
        for r in first_in_ranges(asked, folk, k).orderBy("criteria_id", "rank").collect():
            found.setdefault(r["criteria_id"], []).append(r["patient_id"])
        assert found == {c: p[:k] for c, p in inside.items() if p}


def test_nobody_and_no_range(spark):
    _, _, folk, asked = _tables(spark, [1, 2])
    for people, ranges in ((folk.limit(0), asked), (folk, asked.limit(0))):
        assert count_in_ranges(ranges, people, steps_bounded=True).count() == 0
        assert first_in_ranges(ranges, people, 3).count() == 0


def test_late_rows_go_before_the_sort(spark, monkeypatch):
    monkeypatch.setattr(scale, "SPREAD_ROWS", 0)
    draw = random.Random(2)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.randrange(3), draw.randrange(-500, 10**6)) for _ in range(3000)]
    rows += [("a", 1, None), ("a", 1, -(2**63)), ("c", 0, 7), ("b", None, 5), ("b", 2, 2**63 - 1)]
    for some in (rows, [r for r in rows if r[2] is None or abs(r[2]) < 2**62], rows[:-5]):
        people = spark.createDataFrame(some, "profile string, age int, patient_id bigint")
        left = [tuple(r) for r in scale.without_late_rows(people, ["profile", "age"], "patient_id", 4).collect()]
        def first(all_rows):
            groups = {}
            for r in sorted(all_rows, key=lambda r: (r[2] is not None, r[2] or 0)):
                groups.setdefault(r[:2], []).append(r[2])
            return {g: ids[:4] for g, ids in groups.items()}
        assert first(left) == first(some)
    assert len(left) < 400  # of 3000, 4 of each of 12 groups and what shares their ranges
    _, _, folk, asked = _tables(spark, list(range(10)))
    found = [sorted(map(tuple, first_in_ranges(asked, folk, 3).collect()))]
    monkeypatch.setattr(scale, "SPREAD_ROWS", 10**6)
    found.append(sorted(map(tuple, first_in_ranges(asked, folk, 3).collect())))
    assert found[0] == found[1] and found[0]
