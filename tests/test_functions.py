"""Edge rows with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.functions import vectors as vx
from matchloom.operators import chunking


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_whitespace_is_pythons():
    assert sorted(tx.WHITESPACE) == [chr(i) for i in range(0x110000) if chr(i).isspace()]


def test_parse_conditions(spark):
    got = column(spark, ["a, ,b,", "", None], "string", tx.parse_conditions("x"))
    assert got == [["a", "b"], [], []]


def test_lenient_int(spark):
    values = ["18", "18.9", " 18 ", "NA", "", None, "18 Years", "5d", "-1.5", "1_000", "inf", "nan",
              "1e3", ".5", "1e30", "1__0"]
    got = column(spark, values, "string", tx.lenient_int("x"))
    assert got == [18, 18, 18, None, None, None, None, None, -1, 1000, None, None, 1000, 0, None, None]


def test_extract_between(spark):
    values = ["no marker", "A: rest \n", "A: in B: out A: x B:", "B: A: y"]
    got = column(spark, values, "string", tx.extract_between("x", "A:", "B:"))
    assert got == ["", "rest", "in", "y"]


def test_normalize_key_strips_unicode_space(spark):
    assert column(spark, [" Type 2\x1f "], "string", tx.normalize_key("x")) == ["type 2"]


def test_words_match_python(spark):
    values = ["", " \x85", "a b  c\x1cd\n", "x"]
    assert column(spark, values, "string", tx.words("x")) == [v.split() for v in values]


def test_numbered_fields(spark):
    maps = [
        {"conditions_count": "3", "condition_1": "c1", "condition_2": "", "condition_3": "c3"},
        {"conditions_count": "0", "condition_1": "c1"},
        {"condition_1": "c1"},
        {"conditions_count": "2", "condition_2": "c2"},
    ]
    expr = tx.joined_numbered_fields("x", "condition_", "conditions_count")
    assert column(spark, maps, "map<string,string>", expr) == ["c1, c3", "", "", "c2"]


def test_l2_normalize_keeps_zero_vectors(spark):
    got = column(spark, [[3.0, 4.0], [0.0, 0.0]], "array<float>", vx.l2_normalize("x"))
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_hash_embedding_is_unit_or_zero(spark):
    got = column(spark, ["hot gizmo", "!!!"], "string", vx.l2_norm(vx.hash_embedding("x")))
    assert got == [pytest.approx(1.0, abs=1e-6), 0.0]


@pytest.mark.parametrize(
    "text, primary, secondary",
    [
        ("- PRIMARY: a - SECONDARY: b", ["a"], ["b"]),
        ("- PRIMARY: a\nb\n- PRIMARY:   ", ["a\nb"], []),
        ("- PRIMARY: - SECONDARY: c", ["- SECONDARY: c"], []),
        ("-PRIMARY:x-SECONDARY:y-PRIMARY: z", ["x", "z"], ["y"]),
        ("- primary: a", [], []),
    ],
)
def test_outcomes(spark, text, primary, secondary):
    assert column(spark, [text], "string", chunking.split_outcomes("x", "PRIMARY")) == [primary]
    assert column(spark, [text], "string", chunking.split_outcomes("x", "SECONDARY")) == [secondary]


def test_title(spark):
    values = ["Title: A Title: B \nrest", "Title:x", "plain"]
    assert column(spark, values, "string", chunking.section_title("x")) == ["A B", "x", "plain"]


def test_pack_words_small(spark):
    assert column(spark, ["aaaa bbbb cc"], "string", chunking.pack_words("x", 10)) == [
        ["aaaa bbbb", "cc"]
    ]


def test_pack_words_against_a_loop(spark):
    import random

    draw = random.Random(5)
    bits = ["a", "bb", "ccc é", "\n", " ", " ", "  ", "dddddd", "😀", "\x85"]
    rows = [
        ("".join(draw.choice([*bits, "x" * draw.randint(1, 15)]) for _ in range(draw.randint(0, 40))),
         draw.randint(2, 20))
        for _ in range(1500)
    ]
    df = spark.createDataFrame(rows, "t string, room int")
    for r in df.select("t", "room", chunking.pack_words("t", F.col("room")).alias("p")).collect():
        expected, used = [], r.room + 1
        for word in r.t.split():
            if used + len(word) + 1 > r.room:
                expected.append([])
                used = 0
            expected[-1].append(word)
            used += len(word) + 1
        assert r.p == [" ".join(g) for g in expected]


def test_hash_embedding_parts_and_nulls(spark, monkeypatch):
    import hashlib

    import pyarrow as pa

    lists = [["hot", "gizmo", "hot"], None, [], ["ñ"]]
    found = vx._hashed(pa.array(lists, pa.list_(pa.string())), 8).to_pylist()
    for tokens, vector in zip(lists, found):
        want = [0.0] * 8 if tokens is not None else [None] * 8
        for token in tokens or ():
            want[int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % 8] += 1
        norm = sum(x * x for x in want) ** 0.5 if tokens else 1.0
        assert vector == ([None] * 8 if tokens is None else [pytest.approx(x / norm) for x in want])
    rows = spark.createDataFrame([(i, "a b c " * i) for i in range(40)] + [(99, None)], "i int, x string")
    whole = dict(rows.select("i", vx.hash_embedding("x")).collect())
    monkeypatch.setattr(vx, "HASH_TOKENS", 50)
    assert dict(rows.select("i", vx.hash_embedding("x")).collect()) == whole
    assert whole[99] == [None] * 64 and whole[0] == [0.0] * 64
