"""Filters that each request brings, against one search per request."""

import numpy as np
from pyspark.sql import functions as F

from matchloom.operators import similarity
from matchloom.operators.filters import RequestFilters
from matchloom.operators.retrieval import min_enrollment_filter, phase_status_filter
from matchloom.plans import search

SCHEMA = "chunk_id string, nct_id string, chunk_index int, text string, phase string, status string, enrollment bigint"
PHASES, STATES, SIZES = (None, "", "1", "2", "unseen"), (None, "open", "shut"), (None, 0, 1, 40, 2**40)


def index_of(spark, path):
    random = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(30)])
    rows = [
        (f"N{i}_chunk_0", f"N{i}", 0, " ".join(random.choice(words, 8)), (None, "1", "2", "")[i % 4],
         (None, "open", "shut")[i % 3], (None, 5, 40, 41, 900)[i % 5])
        for i in range(200)
    ]
    search.write_search_index(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    return search.read_search_index(spark, path, None)


def requests_of(spark):
    asked = [(p, s, m) for p in PHASES for s in STATES for m in SIZES]
    rows = [(i, f"w{i % 30} w{i % 7} w{i % 11}", *a) for i, a in enumerate(asked)]
    return spark.createDataFrame(rows, "query_id int, query string, phase string, status string, min_enrollment bigint")


def listed(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 7)) for r in df.collect())


def test_own_filters_like_one_search_each(spark, tmp_path):
    index, requests = index_of(spark, str(tmp_path / "index")), requests_of(spark)
    found = listed(search.rank_chunks(index, requests, k=4, queries_at_most=75, filters=search.CHUNK_FILTERS))
    assert {q for q, *_ in found} < set(range(75))
    for request in requests.filter("query_id % 9 = 4").collect():
        keep = phase_status_filter(request.phase, request.status) & min_enrollment_filter(request.min_enrollment)
        chunks = index.chunks.filter(keep)
        own = search.SearchIndex(chunks, index.lexical._replace(forward=chunks, blocks=None), None)
        alone = requests.filter(F.col("query_id") == request.query_id)
        expected = listed(search.rank_chunks(own, alone, k=4))
        assert [f for f in found if f[0] == request.query_id] == expected


def test_the_plan_scans_the_chunks_once_a_leg(spark, tmp_path):
    index, requests = index_of(spark, str(tmp_path / "index")), requests_of(spark)
    for leg in search.LEGS:
        ranked = search.rank_chunks(
            index, requests, k=4, legs=(leg,), queries_at_most=75, filters=search.CHUNK_FILTERS
        )
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1


def test_the_grid_obeys_filters(spark):
    random = np.random.default_rng(5)
    vectors = random.normal(size=(60, 4)).astype("float32")
    rows = [(f"c{i:02}", v.tolist(), ("a", None, "b")[i % 3], (None, 7)[i % 2]) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame(rows + [("none", None, "a", 7)], "chunk_id string, embedding array<float>, kind string, size bigint")
    asked = [(i, vectors[i].tolist(), ("a", None, "c")[i % 3], (None, 7, 0)[i % 2]) for i in range(12)]
    queries = spark.createDataFrame(asked, "query_id int, embedding array<float>, kind string, least bigint")
    filters = RequestFilters(equal=(("kind", "kind"),), at_least=(("least", "size"),))
    streamed = listed(similarity.top_k_by_dot(queries, corpus, 3, filters=filters))
    assert listed(similarity.top_k_by_dot(queries, corpus, 3, filters=filters, block_rows=5)) == streamed
    expected = []
    for q, v, kind, least in asked:
        allowed = [r for r in rows if (kind is None or r[2] == kind) and (r[3] or 0) >= (least or 0)]
        best = sorted((-round(float(np.dot(np.float64(v), np.float32(r[1]).astype(float))), 6), r[0]) for r in allowed)
        expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best[:3])]
    assert [x[:3] for x in streamed] == [x[:3] for x in sorted(expected)]
