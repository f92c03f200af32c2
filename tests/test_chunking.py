import pytest

from matchloom.operators import chunking


def chunks(spark, document, max_length):
    df = spark.createDataFrame([("N1", document)], "nct_id string, document string")
    rows = chunking.chunk_documents(df, max_length=max_length).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in rows] == [f"N1_chunk_{i}" for i in range(len(rows))]
    return [r.text for r in rows]


DOCUMENT = (
    "Title: T\nEligibility:\nInclusion Criteria: " + "word " * 100
    + "\nExclusion Criteria: none\nConditions: a, b\nLocations: here\nInterventions: drug\n"
    "Outcomes:\n- PRIMARY: one\n- SECONDARY: two\n- SECONDARY: three"
)


def test_order_and_content(spark):
    got = chunks(spark, DOCUMENT, 4096)
    assert [t.split("\n")[1].split(":")[0] for t in got] == [
        "Conditions", "Inclusion Criteria", "Exclusion Criteria", "Locations", "Interventions",
        "Primary Outcomes", "Secondary Outcomes",
    ]
    assert got[-1] == "Title: T\nSecondary Outcomes:\n  - two\n  - three\n"


def test_long_section_is_split_and_keeps_all_words(spark):
    got = [t for t in chunks(spark, DOCUMENT, 200) if "Inclusion" in t]
    header = "Title: T\nInclusion Criteria: "
    assert len(got) == 3 and all(len(t) <= 200 and t.startswith(header) for t in got)
    assert " ".join(t.removeprefix(header) for t in got).split() == ["word"] * 100


def test_little_room_cuts_to_100_characters(spark):
    got = [t for t in chunks(spark, DOCUMENT, 120) if "Inclusion" in t]
    assert got == ["Title: T\nInclusion Criteria: " + ("word " * 100)[:100]]


def test_over_long_overview_splits_the_title_off(spark):
    document = "Title: T\nConditions: " + ", ".join(f"cond{i}" for i in range(60))
    got = chunks(spark, document, 200)
    assert got[0] == "Title: T"
    assert all(t.startswith("Title: T\nConditions: cond") for t in got[1:]) and len(got) > 2


def test_outcomes_are_packed_and_never_dropped(spark):
    items = "".join(f"- PRIMARY: outcome {i}\n" for i in range(40)) + "- PRIMARY: " + "z" * 300
    got = [t for t in chunks(spark, "Title: T\nOutcomes:\n" + items, 200) if "Primary" in t]
    lines = [line for t in got for line in t.split("\n")[2:] if line]
    assert lines == [f"  - outcome {i}" for i in range(40)] + ["  - " + "z" * 300]
    assert all(len(t) <= 200 for t in got[:-1])


def test_conditions_marker_is_the_first_in_the_text(spark):
    df = spark.createDataFrame(
        [("N", "Title: x\nConditions: early\nEligibility: e\nConditions: late\nLocations: l")],
        "nct_id string, document string",
    )
    row = chunking.with_sections(df).first()
    assert row.conditions == "early\nEligibility: e\nConditions: late" and row.locations == "l"


def test_empty_documents(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "nct_id string, document string")
    split = chunking.split_empty_documents(df, "document")
    assert split.good.count() == 1 and split.rejected.count() == 2
    with pytest.raises(ValueError):
        chunking.split_empty_documents(df, "document", strict=True)


def test_summary(spark):
    df = spark.createDataFrame([("N1", DOCUMENT), ("N2", "Title: y")], "nct_id string, document string")
    row = chunking.chunk_summary(chunking.chunk_documents(df), df).first()
    assert tuple(row) == (2, 8, 4.0)
