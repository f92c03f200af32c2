"""The ways taken when a side is large or a key is hot, against the simple way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import quality, scale, similarity
from matchloom.operators import ann
from matchloom.operators.ann import ann_top_k, rows_scored, train_cells


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows has key 0."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("k"),
        F.col("id").alias("v"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_key_join_equals_plain_join(spark, skewed, how):
    small = spark.range(0, 900, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = scale.lookup_join(skewed, small, ["k"], how=how, small_is_bounded=False, hot_rows=500)
    assert rows(got) == rows(skewed.join(small, "k", how))
    assert rows(scale.hot_keys(skewed, ["k"], 500)) == [(0,)]


def test_unbounded_sides_are_not_broadcast(spark):
    """Sides that compress well are small in bytes only; none may go through the driver."""
    big = spark.range(300_000).select((F.col("id") % 40_000).alias("k"), F.lit(1).alias("v"))
    small = spark.range(0, 40_000, 2, 4).select(F.col("id").alias("k")).distinct()
    found = scale.lookup_join(big, small, ["k"], small_is_bounded=False)
    assert found.count() == 150_000
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_salted_top_k_equals_plain(spark, skewed, monkeypatch):
    order = [F.col("v").desc()]
    plain = rows(scale.top_k_per_group(skewed, ["k"], order, 7))
    monkeypatch.setattr(scale, "MAP_SIDE_RANK_LIMIT", 3)
    assert rows(scale.top_k_per_group(skewed, ["k"], order, 7)) == plain
    assert scale.top_k_per_group(skewed, ["k"], order, 0).count() == 0


def test_dense_ids_are_the_row_numbers(spark):
    df = spark.range(5000).filter("id % 7 <> 3").select((F.col("id") * 5).alias("place"))
    got = scale.dense_ids(df, "place", block_rows=100).orderBy("place").collect()
    assert [r.id for r in got] == list(range(1, len(got) + 1))


def test_large_sample_equals_small_sample(spark):
    df = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("id"))
    for k in (1, 500, 3000):
        heap = rows(scale.sample_exact(df, "id", k, seed=3))
        assert len(heap) == k
        assert rows(scale.sample_exact(df, "id", k, seed=3, heap_rows=0)) == heap
    assert rows(scale.sample_exact(df, "id", 500, 4)) != rows(scale.sample_exact(df, "id", 500, 3))
    with pytest.raises(ValueError):
        scale.sample_exact(df, "id", 3001)


def vectors(spark, n, seed, name):
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(n, 8)).astype("float32")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    data = [(f"{name}{i:03d}", [float(x) for x in row]) for i, row in enumerate(v)]
    data.append((f"{name}none", None))
    return v.astype("float64"), spark.createDataFrame(data, "id string, embedding array<float>")


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_pairs_against_brute_force(spark, block_rows):
    a, left = vectors(spark, 90, 1, "a")
    b, right = vectors(spark, 70, 2, "b")
    got = similarity.pairs_at_least(
        left, right, 0.5, left_id="id", right_id="id", block_rows=block_rows
    )
    scores = np.round(a @ b.T, 6)
    expected = {(f"a{i:03d}", f"b{j:03d}") for i, j in zip(*np.nonzero(scores >= 0.5))}
    assert {(r.left_id, r.right_id) for r in got.collect()} == expected


@pytest.mark.parametrize("block_rows", [4096, 4])
def test_top_k_against_brute_force(spark, block_rows):
    a, corpus = vectors(spark, 200, 3, "c")
    b, queries = vectors(spark, 10, 4, "q")
    got = similarity.top_k_by_dot(
        queries.withColumnRenamed("id", "query_id"),
        corpus.withColumnRenamed("id", "chunk_id"),
        7,
        block_rows=block_rows,
    )
    scores = np.round(a @ b.T, 6)
    expected = set()
    for q in range(10):
        order = sorted(range(200), key=lambda i: (-scores[i, q], i))[:7]
        expected |= {(f"q{q:03d}", f"c{i:03d}", n + 1) for n, i in enumerate(order)}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == expected


def test_ties_go_to_the_smaller_id(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "chunk_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    got = similarity.top_k_by_dot(queries, corpus.repartition(5), 3)
    assert sorted(r.chunk_id for r in got.collect()) == [0, 1, 2]


def test_ann_with_all_cells_is_exact(spark):
    _, corpus = vectors(spark, 200, 3, "c")
    _, queries = vectors(spark, 10, 4, "q")
    corpus = corpus.withColumnRenamed("id", "chunk_id")
    queries = queries.withColumnRenamed("id", "query_id")
    centroids = train_cells(corpus, 5)
    exact = rows(similarity.top_k_by_dot(queries, corpus, 5))
    assert rows(ann_top_k(queries, corpus, 5, centroids, 5)) == exact
    assert len(rows(ann_top_k(queries, corpus, 5, centroids, 1))) <= len(exact)


def test_ann_queries_in_parts(spark, monkeypatch):
    """Queries that travel in several parts, one of them without a vector."""
    _, corpus = vectors(spark, 60, 3, "c")
    _, queries = vectors(spark, 25, 4, "q")
    corpus = corpus.withColumnRenamed("id", "chunk_id")
    none = spark.createDataFrame([("none", None)], queries.schema)
    queries = queries.union(none).withColumnRenamed("id", "query_id")
    centroids = train_cells(corpus, 3)
    whole = rows(ann_top_k(queries, corpus, 4, centroids, 2))
    assert len({r[0] for r in whole}) == 25
    monkeypatch.setattr(ann, "BLOCK_ROWS", 6)
    assert rows(ann_top_k(queries, corpus, 4, centroids, 2)) == whole
    celled = ann.with_cells(corpus, centroids)
    assert {r.rows_all for r in rows_scored(queries, celled, centroids, 3).collect()} == {60}


def test_quality_rules(spark):
    df = spark.createDataFrame(
        [("p1", "a", 1), ("p1", "b", 2), ("p2", None, 3), ("p2", "c", 4), ("zz", "d", 5), (None, "e", 6)],
        "pid string, c string, at int",
    )
    first = quality.keep_first_by_key(df.filter("pid is not null"), ["pid"], ["at"])
    assert sorted(r["at"] for r in first.collect()) == [1, 3, 5]
    split = quality.split_nulls(df, ["pid", "c"])
    assert split.good.count() == 4
    assert {r.missing_columns for r in split.rejected.collect()} == {"c", "pid"}
    parent = spark.createDataFrame([("p1",), ("p2",)], "pid string")
    parted = quality.split_by_parent(df, parent, "pid")
    assert (parted.good.count(), parted.rejected.count()) == (4, 2)
    report = quality.load_report("t", df, required=["pid", "c"], key="pid").first()
    assert tuple(report) == ("t", 6, 3, 3, 0)


def _clustered(spark, n, seed, zero=True):
    """Unit vectors around ten directions, with a zero one and a missing one."""
    draw = np.random.default_rng(3)
    centres = np.linalg.qr(draw.normal(size=(16, 16)))[0][:10]
    draw = np.random.default_rng(seed)
    v = centres[draw.integers(0, 10, n)] + draw.normal(0, 0.03, (n, 16))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    v[0] = 0
    rows = [(f"k{i}", x.tolist()) for i, x in enumerate(v)] + [("none", None)]
    return v.astype(float), spark.createDataFrame(rows, "key string, embedding array<float>").repartition(5)


@pytest.mark.parametrize("threshold", [-2.0, 0.0, 0.75, 0.99])
def test_pairs_of_near_cells(spark, threshold):
    a, left = _clustered(spark, 300, 1)
    b, right = _clustered(spark, 150, 2)
    found = similarity.pairs_at_least(
        left, right, threshold, left_id="key", right_id="key", block_rows=20
    ).collect()
    scores = similarity._round_half_up(a @ b.T)
    wanted = {(f"k{i}", f"k{j}") for i, j in np.argwhere(scores >= threshold)}
    assert len(found) == len(wanted) and {(r.left_id, r.right_id) for r in found} == wanted


def test_far_cells_do_not_meet():
    pivots = np.eye(10)
    radius = np.full(10, 0.1)
    radius[9] = -1
    near = similarity.near_cells(pivots, radius, radius, 0.75)
    assert near.tolist() == [[i, i] for i in range(9)]


def test_pairs_of_nothing(spark):
    _, some = _clustered(spark, 30, 1)
    for left, right in ((some.limit(0), some), (some.filter("embedding is null"), some)):
        assert similarity.pairs_at_least(
            left, right, 0.5, left_id="key", right_id="key", block_rows=4
        ).count() == 0
