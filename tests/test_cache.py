"""Vectors that earlier requests stored."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom import find_eligible_patients
from matchloom.operators.cache import EmbeddingCache, embed_cached


def counting(folder, refused=()):
    """A model that leaves a file for every text it is given."""

    def load():
        import uuid
        from pathlib import Path

        def encode(texts):
            for t in texts:
                if t in refused:
                    raise MemoryError(t)
                Path(folder, uuid.uuid4().hex).write_text(str(t))
            return np.array([[len(t or ""), 1.0, ord((t or "x")[0])] for t in texts], dtype=np.float32)

        return encode

    return load


def seen(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def keys(spark, *texts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "key string, hash_of int")


def vectors(df):
    return sorted(((r["key"], r["hash_of"], r["embedding"] and tuple(r["embedding"]), r["error"]) for r in df.collect()), key=str)


def test_only_new_texts_reach_the_model(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    cache = EmbeddingCache(str(tmp_path / "vectors"), "m1")
    model = counting(str(calls))
    first = vectors(embed_cached(keys(spark, "aa", "b", "é"), "key", cache, embedder=model))
    assert first[0] == ("aa", 0, (2.0, 1.0, 97.0), None) and seen(calls) == ["aa", "b", "é"]
    second = vectors(embed_cached(keys(spark, "b", "ccc", "", "é"), "key", cache, embedder=model))
    assert [r[0] for r in second] == ["", "b", "ccc", "é"] and seen(calls) == ["", "aa", "b", "ccc", "é"]
    assert second == vectors(embed_cached(keys(spark, "b", "ccc", "", "é"), "key", None, embedder=model))
    before = len(seen(calls))
    assert vectors(embed_cached(keys(spark, "b", "ccc", "", "é"), "key", cache, embedder=model)) == second
    assert len(seen(calls)) == before
    embed_cached(keys(spark, "aa"), "key", EmbeddingCache(cache.path, "m2"), embedder=model).collect()
    assert len(seen(calls)) == before + 1
    assert embed_cached(keys(spark), "key", cache, embedder=model).count() == 0


def test_refused_texts_are_tried_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    cache = EmbeddingCache(str(tmp_path / "vectors"), "m")
    rows = vectors(embed_cached(keys(spark, "ok", "bad"), "key", cache, embedder=counting(str(calls), ("bad",))))
    assert [(r[0], r[2] is None, r[3]) for r in rows] == [("bad", True, "MemoryError: bad"), ("ok", False, None)]
    rows = vectors(embed_cached(keys(spark, "ok", "bad"), "key", cache, embedder=counting(str(calls))))
    assert all(r[2] and r[3] is None for r in rows) and seen(calls) == ["bad", "ok"]


def test_texts_stored_twice_are_found_once(spark, tmp_path):
    cache = EmbeddingCache(str(tmp_path / "vectors"), "m")
    embed_cached(keys(spark, "a", "b"), "key", cache)
    cache.add(cache.stored(spark).select(F.col("part").cast("string"), "hash", "embedding"))
    assert embed_cached(keys(spark, "a", "b", "c"), "key", cache).count() == 3
    assert cache.stored(spark).count() == 5


@pytest.mark.parametrize("stored", [True, False])
def test_second_cohort_request_calls_no_model(spark, tmp_path, stored):
    calls = tmp_path / "calls"
    calls.mkdir()
    people = spark.createDataFrame(
        [(i, 50, "F", "r", "e", "n") for i in range(3)],
        "patient_id int, age int, gender string, race string, ethnicity string, name string",
    )
    conditions = spark.createDataFrame([(0, "asthma"), (1, "gout"), (2, "Asthma ")], "patient_id int, conditions string")
    cache = EmbeddingCache(str(tmp_path / "vectors"), "m") if stored else None
    model = counting(str(calls))

    def ask():
        found = find_eligible_patients(
            spark, people, conditions, age_min=40, age_max=60, required_conditions=["asthma"], embedder=model,
            cache=cache, threshold=1.0,
        )
        return found.count()

    first = ask()
    before = len(seen(calls))
    assert ask() == first == 3 and before > 0
    assert len(seen(calls)) == (before if stored else 2 * before)
