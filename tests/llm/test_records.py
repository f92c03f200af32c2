"""Archives, nearest rows, the classifier and the pipeline."""

import gzip
import hashlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import duck
from matchloom.llm import knn, quality, warc
from matchloom.llm.queries import ORACLE_SQL, REGISTRY
from matchloom.storage import new_table_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://x/{i}", "page " * (i % 7) + "ü" * 60 * (i % 3)) for i in range(40)]
    rows += [(100, "a\r\nb é", None), (101, None, ""), (None, "u", "long " * 40), (102, "u", "long " * 40),
             (102, "u", "long " * 40), (103, "v", "long " * 40), (104, "big", "0123456789" * 40000)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string"), rows


@pytest.mark.parametrize("split_bytes", [1 << 20, 200])
def test_warc_round_trip(pages, split_bytes):
    table, rows = pages
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    expected = []
    for i, url, html in rows:
        body = (html or "").encode()
        refers = first[html or ""] if i is not None and len(body) >= 100 and first[html or ""] < i else None
        expected.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if refers is not None else "response", refers, url or ""))
    found = warc.archive_round_trip(table.repartition(3), split_bytes).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_warc_skips_damage_and_false_magic(spark, tmp_path):
    def record(name, body):
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    stored = gzip.compress(record("a", b"x" * 50 + warc.MAGIC + b"not gzip" * 9), 0)
    damaged = bytearray(gzip.compress(record("b", b"y" * 500)))
    damaged[len(damaged) // 2] ^= 255
    other = gzip.compress(b"no record at all")
    path = tmp_path / "x.warc.gz"
    path.write_bytes(stored + bytes(damaged) + other + gzip.compress(record("c", b"z")))
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "file string, bytes bigint")
    for split_bytes in (64, 1 << 20):
        found = warc.read_archives(spark, files, split_bytes).select("record_id").collect()
        assert sorted(r[0] for r in found) == ["a", "c"]


def test_warc_files_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    files = warc.write_archives(empty, new_table_path(spark, "none"))
    assert warc.read_archives(spark, files).count() == 0


def brute_nearest(rows, k, scale=1024):
    fit = [
        (i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = set()
    for q, u in {(i, tuple(v)) for i, v in fit if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, v in fit if i != q)[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"pivots": 4, "group_queries": 1, "part_rows": 3}])
def test_knn_brute_force(spark, options):
    random = np.random.default_rng(0)
    rows = [(int(i), random.normal(size=6).round(1).tolist()) for i in range(0, 900, 3)]
    rows += [(1, None), (2, [1.0, None]), (200, [float("nan")] * 6), (4, [float("inf")] * 6), (None, [1.0] * 6),
             (5, rows[0][1]), (7, rows[0][1]), (8, [2.0]), (500, [])]
    data = spark.createDataFrame([(i, v, "extra") for i, v in rows], "vec_id bigint, embedding array<double>, cell string")
    found = knn.nearest(data.repartition(4), F.col("id") % 100 == 0, 10, **options).collect()
    assert {tuple(r) for r in found} == brute_nearest(rows, 10)


@pytest.mark.parametrize("options", [{}, {"pivots": 4, "group_queries": 1, "part_rows": 3}])
def test_knn_ids_of_many_rows(spark, options):
    schema = "vec_id bigint, embedding array<double>"
    near = [(100, [10.0, 0.0])] * 12 + [(i, [1.0, 0.0]) for i in range(1, 21)]
    random = np.random.default_rng(1)
    third = [(0 if i % 3 == 0 else i, random.normal(size=4).round(1).tolist()) for i in range(1, 240)]
    for rows in (near, third):
        found = knn.nearest(spark.createDataFrame(rows, schema), F.col("id") % 100 == 0, 10, **options).collect()
        expected = brute_nearest(rows, 10)
        assert expected and {tuple(r) for r in found} == expected


def test_knn_few_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert knn.nearest(spark.createDataFrame([], schema), F.col("id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in knn.nearest(few, F.col("id") % 100 == 0).orderBy("rank").collect()] == [
        (0, 1, 1, 2048 * 1024), (0, 2, 1, 2048 * 1024)
    ]
    assert knn.nearest(few, F.col("id") == 77).count() == 0


def test_quality_held_out(spark):
    found = REGISTRY["op3_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas()
    both = found.merge(labels, on="doc_id")
    assert len(found) == 1000 and found["score"].between(0, 1).all()
    held = both[both["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93
    assert ((found["score"] >= 0.3) == (found["predicted"] == 1)).all()


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 3), (2, "", 3), (None, "some text", 3), (4, "word " * 5000, 3), (4, "word " * 5000, 3)],
        "doc_id bigint, text string, score int",
    )
    labels = spark.createDataFrame([(2, None), (1, 1), (1, 0), (4, 1)], "doc_id bigint, quality int")
    found = quality.classify(docs, labels).select("doc.doc_id", "doc.score", "score", "n_passages").collect()
    assert len(found) == 5
    assert all(r[1] == 3 and 0 <= r[2] <= 1 for r in found)
    assert found[0][2] == found[1][2] and sorted(r[3] for r in found) == [1, 1, 1, 40, 40]
    no_labels = labels.limit(0)
    assert {r["score"] for r in quality.classify(docs, no_labels).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_quality_gradients():
    random = np.random.default_rng(1)
    x, first, y = random.normal(size=(7, quality.FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    model = quality.fit(x, first, y, epochs=1)

    def loss():
        p = model.forward(x, first)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = model.gradients(model.forward(x, first), y, first)
    for name in ("W", "V", "U", "w", "c", "d"):
        weight = model.weights[name]
        at = tuple(0 for _ in weight.shape)
        kept = weight[at]
        weight[at] = kept + 1e-5
        up = loss()
        weight[at] = kept - 1e-5
        down = loss()
        weight[at] = kept
        assert found[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = new_table_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    packed = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    pieces = docs.count()
    assert sum(r.piece == 0 for r in packed) == pieces
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


def test_pipeline_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (3, "", "en", "s", 0),
         (4, "q w e r t y u", "en", "t", 13), (5, "q w e r t y u", "en", "t", 13), (4, "q w e r t y u", "en", "t", 13)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted([1, None, None, 3, 4], key=str)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        stage(spark, docs, SF).collect()


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    one, two = "alpha beta gamma delta epsilon zeta", "one two three four five six"
    docs = spark.createDataFrame(
        [(1, one, "en", "s", 1), (1, two, "en", "s", 1), (1, one, "en", "t", 1), (2, two, "en", "s", 1),
         (3, "seven words that nobody else has here", "en", "s", 1), (0, one, "en", "u", 1)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [
        (0, one), (1, two), (3, "seven words that nobody else has here")
    ]


@pytest.mark.parametrize("name", ["op2_warc_archives", "op5_exact_top_k"])
def test_queries_equal_sql(spark, name):
    folder = SF.replace("0.001", "0.01")
    sql = duck(folder).execute(ORACLE_SQL[name])
    columns = [d[0] for d in sql.description]
    found = REGISTRY[name](spark, folder)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(sql.fetchall())
