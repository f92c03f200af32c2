import json

import pytest
from pyspark.sql import functions as F

from matchloom.operators import embedding
from matchloom.plans import cohort, search
from matchloom.sources import sinks, tables
from matchloom.streaming import incremental


@pytest.fixture()
def trials_file(tmp_path):
    data = {
        f"NCT{i}": {
            "document": f'Title: "t{i}" }}}}, {{ é\nConditions: x',
            "metadata": {"nct_id": f"NCT{i}", "phase": "P1", "enrollment": i, "conditions_count": 2,
                         "condition_1": "a, b", "condition_2": "", "interventions_count": 1},
        }
        for i in range(40)
    }
    path = tmp_path / "trials.json"
    path.write_text(json.dumps(data), encoding="utf-8")
    return str(path), data


@pytest.mark.parametrize("layout", ["object", "split"])
def test_json_layouts(spark, trials_file, layout):
    path, data = trials_file
    got = {r.nct_id: r for r in tables.load_trials(spark, path, layout).collect()}
    assert set(got) == set(data)
    assert all(got[k].document == data[k]["document"] for k in data)
    row = tables.trial_table(tables.load_trials(spark, path, layout)).filter("nct_id = 'NCT7'").first()
    assert (row.conditions, row.condition_list, row.enrollment) == ("a, b", ["a, b"], 7)
    assert set(row.metadata) == {"nct_id", "phase", "enrollment", "conditions_count"}


@pytest.fixture()
def small_ranges(spark):
    """Some two hundred bytes a task, so that records lie across ranges."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, size in zip(names, ("200", "10")):
        spark.conf.set(n, size)
    yield
    for n, size in zip(names, before):
        spark.conf.set(n, size)


HARD_TEXTS = (
    "d}}, ", "}", "{", '"', "\\", '\\"}', '{"x": {"y": "z"}}', "}}}" * 100, "long " * 300, "", "é}\u2028{\n}", '}}, "N9": {"',
)


@pytest.mark.parametrize("form", ["compact", "spaced", "indented", "ascii"])
def test_split_layout_reads_any_spelling(spark, small_ranges, tmp_path, form):
    records = {
        f"N{i}" + "}" * (i % 5 == 4): {"metadata": {"a{": t, "b": "}"}, "document": t * (1 + i % 3)}
        for i, t in enumerate(HARD_TEXTS * 4)
    }
    records["null"] = None
    options = {
        "compact": {"separators": (",", ":"), "ensure_ascii": False}, "spaced": {"ensure_ascii": False},
        "indented": {"indent": 2, "ensure_ascii": False}, "ascii": {},
    }[form]
    for n, part in enumerate((records, {}, {"last": None}, {"one": {"document": "x", "metadata": {}}})):
        (tmp_path / f"{n}.json").write_text(json.dumps(part, **options) + "\n" * n, encoding="utf-8")
    got = {r.nct_id: (r.document, r.metadata) for r in tables.load_trials(spark, str(tmp_path), "split").collect()}
    expected = {k: (v["document"], v["metadata"]) if v else ("", {}) for k, v in records.items()}
    assert got == expected | {"last": ("", {}), "one": ("x", {})}
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 20


def test_split_layout_is_whole_or_raises(spark, small_ranges, tmp_path):
    text = json.dumps({f"N{i}": {"document": "d" * 50, "metadata": {}} for i in range(20)})
    for end in (len(text) - 1, len(text) - 2, len(text) - 10, len(text) // 2):
        path = tmp_path / f"{end}.json"
        path.write_text(text[:end])
        with pytest.raises(Exception, match="not a whole JSON map"):
            tables.load_trials(spark, str(path), "split").collect()


def test_demographics(spark, tmp_path):
    columns = tables.DEMOGRAPHICS_COLUMNS
    values = [(f"p{i % 8}", f"n{i}", i, "F", "S", "r", "e", "1", "a") for i in range(10)]
    df = spark.createDataFrame(values, ",".join(f"{c} {'int' if c == 'age' else 'string'}" for c in columns))
    path = str(tmp_path / "people")
    df.coalesce(1).write.parquet(path)
    clean = tables.clean_demographics(tables.load_demographics(spark, path, file_order=True))
    assert sorted(r.name for r in clean.collect()) == [f"n{i}" for i in range(8)]
    with pytest.raises(ValueError, match="ssn"):
        tables.require_columns(df.drop("ssn"), columns)


CHUNKS = "chunk_id string, nct_id string, text string"


def test_adding_twice_adds_once(spark, tmp_path):
    path = str(tmp_path / "chunks")
    first = spark.createDataFrame([(f"N{i}_chunk_0", f"N{i}", "t") for i in range(20)], CHUNKS)
    more = spark.createDataFrame([(f"N{i}_chunk_0", f"N{i}", "t") for i in range(10, 30)] * 2, CHUNKS)
    for batch in (first, more, more):
        sinks.add_new_chunks(batch, path, buckets=4)
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == sorted(
        f"N{i}_chunk_0" for i in range(30))


def test_new_chunks_of_a_large_batch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "chunks")
    rows = [(f"N{i}_chunk_0", f"N{i}", "t") for i in range(20)]
    sinks.append_chunks(spark.createDataFrame(rows[:12], CHUNKS), path, buckets=4)
    monkeypatch.setattr(sinks, "is_small", lambda df: False)
    fresh = sinks.new_chunks(spark.createDataFrame(rows, CHUNKS), spark.read.parquet(path))
    assert fresh.count() == 8


def test_stream_equals_batch(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    docs = spark.range(30).select(
        F.concat(F.lit("N"), "id").alias("nct_id"),
        F.concat(F.lit("Title: t\nConditions: c"), "id").alias("document"),
    )
    for part in (docs.filter("nct_id < 'N2'"), docs):
        part.write.mode("append").parquet(folder)
        stream = incremental.follow_documents(
            incremental.read_documents(spark, folder, files_per_batch=3), out,
            checkpoint=checkpoint, buckets=4,
        )
        stream.awaitTermination()
    assert sorted(r.nct_id for r in spark.read.parquet(out).collect()) == sorted(
        r.nct_id for r in docs.collect())


def test_stream_into_index(spark, tmp_path):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "index", "checkpoint"))
    docs = spark.range(12).select(
        F.concat(F.lit("N"), "id").alias("nct_id"),
        F.concat(F.lit("Title: t\nConditions: c"), "id").alias("document"),
    )
    for part in (docs.filter("nct_id < 'N2'"), docs):
        part.write.mode("append").parquet(folder)
        stream = incremental.follow_into_index(
            incremental.read_documents(spark, folder), path, checkpoint=checkpoint
        )
        stream.awaitTermination()
    index = search.read_search_index(spark, path, None)
    assert index.chunks.count() == 12 and index.lexical.stats.first()["n_chunks"] == 12
    assert {r.df for r in index.lexical.frequencies.filter("term = 'conditions'").collect()} == {12}


def test_embedder_failures_stay_alone(spark):
    def load():
        import numpy as np

        def encode(texts):
            if any("bad" in t for t in texts):
                raise MemoryError("out of memory")
            return np.array([[float(len(t)), 1.0] for t in texts])

        return encode

    df = spark.createDataFrame([(i, "bad" if i == 13 else "t" * i) for i in range(40)], "i int, t string")
    split = embedding.split_embedded(
        embedding.embed_column(df, "t", embedder=load, partitions=3, spread_by=["i"], batch_size=8)
    )
    assert {r.i: r.embedding[0] for r in split.good.collect()} == {i: float(i) for i in range(40) if i != 13}
    assert [(r.i, r.error) for r in split.rejected.collect()] == [(13, "MemoryError: out of memory")]


def test_a_broken_model_fails_the_job(spark, tmp_path):
    def load():
        def encode(texts):
            raise RuntimeError("no driver")

        return encode

    chunks = spark.createDataFrame([("N1_chunk_0", "N1", 0, "text")], "chunk_id string, nct_id string, chunk_index int, text string")
    with pytest.raises(Exception, match="no driver"):
        search.write_search_index(chunks, str(tmp_path / "index"), embedder=load)
    people = spark.createDataFrame([("p", 50, "F", "r", "e", "n")], "patient_id string, age int, gender string, race string, ethnicity string, name string")
    rows = spark.createDataFrame([("p", "flu")], "patient_id string, conditions string")
    wanted = dict(age_min=1, age_max=99, required_conditions=["flu"], embedder=load)
    with pytest.raises(Exception, match="no driver"):
        cohort.find_eligible_patients(spark, people, rows, **wanted).collect()
    # A tolerated error is not passed over either: it fails, or goes to the quarantine.
    with pytest.raises(ValueError, match="no vectors"):
        cohort.find_eligible_patients(spark, people, rows, tolerate=(RuntimeError,), **wanted)
    path = str(tmp_path / "failed")
    found = cohort.find_eligible_patients(
        spark, people, rows, tolerate=(RuntimeError,), quarantine=path, **wanted
    )
    assert found.count() == 0
    assert {tuple(r)[:2] for r in spark.read.parquet(path).collect()} == {("condition", "flu"), ("requirement", "flu")}


def test_index_counts_what_the_model_refuses(spark, tmp_path):
    def load():
        import numpy as np

        def encode(texts):
            if "bad" in texts:
                raise MemoryError
            return np.ones((len(texts), 2))

        return encode

    rows = [("N1_chunk_0", "N1", 0, "good"), ("N1_chunk_1", "N1", 1, "bad")]
    chunks = spark.createDataFrame(rows, "chunk_id string, nct_id string, chunk_index int, text string")
    path = str(tmp_path / "index")
    assert search.write_search_index(chunks, path, embedder=load) == (1, 1)
    assert [r.chunk_id for r in search.rejected_chunks(spark, path).collect()] == ["N1_chunk_1"]
    assert search.read_search_index(spark, path, None).chunks.count() == 1


def test_embed_input(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"}, "body")], "m map<string,string>, t string")
    assert df.select(embedding.embed_input("t", F.col("m"))).first()[0] == "a: 1\nb: 2\n\nbody"


def test_a_split_file_is_bounded():
    """One task writes a file, so files of the split layout grow in number and not in size."""
    from checks import spark_queries

    assert spark_queries.SPLIT_BYTES <= 128 << 20
