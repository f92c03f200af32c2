"""Postings in blocks, and an index that grows, changes and survives a failed batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import impact, lexical
from matchloom.plans import search

SCHEMA = "chunk_id string, nct_id string, chunk_index int, text string"


def texts(n, seed=0):
    random = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(60)] + ["the"] * 30)
    return [(f"N{i}_chunk_0", f"N{i}", 0, " ".join(random.choice(words, random.integers(1, 25)))) for i in range(n)]


def hits(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 7)) for r in df.collect())


def asked(spark):
    rows = [(1, "the w3 w4 w4"), (2, "the"), (3, "unknown words"), (4, "w59 W58, w57; w56 the the"), (5, "")]
    return spark.createDataFrame(rows, "query_id int, query string")


@pytest.mark.parametrize("block, k", [(1, 7), (4, 1), (128, 500)])
def test_blocks_answer_like_the_scan(spark, monkeypatch, tmp_path, block, k):
    monkeypatch.setattr(impact, "impact_blocks", lambda p, a, f=impact.impact_blocks: f(p, a, block))
    path = str(tmp_path / "index")
    search.write_search_index(spark.createDataFrame(texts(300) + [("N999_chunk_0", "N999", 0, "")], SCHEMA), path)
    index = search.read_search_index(spark, path, None).lexical
    terms = lexical.query_terms(asked(spark), "query_id", "query")
    exact = hits(lexical.bm25_top_k(index, terms, k))
    assert hits(impact.bm25_from_blocks(index, terms, k, first_blocks=1)) == exact and exact


def test_blocks_leave_out_what_cannot_matter(spark, tmp_path):
    rows = [(f"N{i}_chunk_0", f"N{i}", 0, "rare " * (i < 3) + "the " * (1 + i % 9) + "x " * (i % 50)) for i in range(4000)]
    path = str(tmp_path / "index")
    search.write_search_index(spark.createDataFrame(rows, SCHEMA).repartition(4), path)
    index = search.read_search_index(spark, path, None).lexical
    counts = index.blocks.groupBy("term").agg(F.count("*").alias("blocks"), F.max("n").alias("n")).collect()
    by_term = {r["term"]: r for r in counts}
    assert by_term["rare"]["blocks"] == 1 and by_term["the"]["blocks"] >= 4000 / 128
    one = spark.createDataFrame([(1, "rare the")], "query_id int, query string")
    terms = lexical.query_terms(one, "query_id", "query")
    assert hits(impact.bm25_from_blocks(index, terms, 2)) == hits(lexical.bm25_top_k(index, terms, 2))
    read = impact._asked(index.blocks, impact._weighted(index, terms))
    plan = read._jdf.queryExecution().toString()
    assert "term_bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {r[0] for r in read.select("term").distinct().collect()} == {"rare", "the"}


def test_postings_need_no_shuffle(spark, monkeypatch):
    """Chunks are counted where they are; rows of one id and length count as one chunk."""
    rows = [(i % 90, " ".join(["the"] * (i % 5) + [f"w{i % 7}", f"w{i % 3}"])) for i in range(60)]
    rows += [(200, None), (201, ""), (None, "a b a"), (None, "b c d"), (None, "a")]
    again = rows + rows[:20] + [(3, "other words of a length")]
    for table in (rows[:-3], again):
        chunks = spark.createDataFrame(table, "chunk_id bigint, text string").repartition(3)
        monkeypatch.setattr(lexical, "LIST_WORDS", 7)
        index = lexical.build_lexical_index(chunks)
        expected = {}
        for chunk, text in table:
            words = (text or "").split()
            for word in words:
                key = (word, chunk, len(words))
                expected[key] = expected.get(key, 0) + 1
        found = {(r["term"], r["chunk_id"], r["dl"]): r["tf"] for r in index.postings.collect()}
        assert found == expected and index.postings.count() == len(expected)
    plan = lexical.build_lexical_index(spark.createDataFrame(rows[:-3], "chunk_id bigint, text string")).postings
    assert "Exchange" not in plan._jdf.queryExecution().toString()


def test_frequent_terms_in_parts(spark, monkeypatch, tmp_path):
    """Terms above the bound are cut by several tasks; the answers stay."""
    monkeypatch.setattr(lexical, "FILE_ROWS", 40)
    monkeypatch.setattr(lexical, "LIST_WORDS", 30)
    monkeypatch.setattr(impact, "CUT_POSTINGS", 25)
    path = str(tmp_path / "index")
    search.write_search_index(spark.createDataFrame(texts(300), SCHEMA).repartition(3), path)
    index = search.read_search_index(spark, path, None).lexical
    assert index.blocks.count() == index.blocks.select("term", "block").distinct().count()
    assert index.blocks.filter("term = 'the'").select(F.shiftright("block", 32)).distinct().count() > 1
    terms = lexical.query_terms(asked(spark), "query_id", "query")
    assert hits(impact.bm25_from_blocks(index, terms, 9)) == hits(lexical.bm25_top_k(index, terms, 9))
    built = lexical.build_lexical_index(spark.createDataFrame(texts(300), SCHEMA))
    assert sorted(index.postings.collect()) == sorted(built.postings.collect())


def test_block_search_does_not_grow_with_queries(spark, monkeypatch, tmp_path):
    """Queries that share their terms share the blocks and postings read, in any number of parts."""
    path, seen = str(tmp_path / "index"), []
    search.write_search_index(spark.createDataFrame(texts(200), SCHEMA), path)
    index = search.read_search_index(spark, path, None).lexical
    one = spark.createDataFrame([(1, "the w3 w4 w9")], "query_id int, query string")
    many = spark.createDataFrame([(i, "the w3 w4 w9") for i in range(40)], one.schema)
    monkeypatch.setattr(impact, "materialize", lambda d, n, f=impact.materialize: seen.append((n, d.count())) or f(d, n))
    monkeypatch.setattr(lexical, "POSTING_ROWS", 30)
    for queries in (one, many):
        terms = lexical.query_terms(queries, "query_id", "query")
        assert hits(impact.bm25_from_blocks(index, terms, 6)) == hits(lexical.bm25_top_k(index, terms, 6))
    sizes = [n for name, n in seen if name.startswith(("block", "needed"))]
    assert sizes[: len(sizes) // 2] == sizes[len(sizes) // 2 :]
    monkeypatch.setattr(impact, "QUERY_ROWS", 9)
    assert hits(impact.bm25_from_blocks(index, terms, 6)) == hits(lexical.bm25_top_k(index, terms, 6))


def test_a_batch_that_failed_is_not_seen(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "index"), texts(60)
    first, rest = rows[:20], rows[15:]
    search.extend_search_index(spark.createDataFrame(first, SCHEMA), path)
    before = search.read_search_index(spark, path, None)
    for broken in ("add_counts", "write_lexical_index"):
        with monkeypatch.context() as patch:
            patch.setattr(lexical, broken, lambda *a, **b: (_ for _ in ()).throw(OSError("executor lost")))
            with pytest.raises(OSError):
                search.extend_search_index(spark.createDataFrame(rest, SCHEMA), path)
        after = search.read_search_index(spark, path, None)
        assert after.chunks.count() == before.chunks.count() == 20
        assert after.lexical.stats.first() == before.lexical.stats.first()
    assert search.extend_search_index(spark.createDataFrame(rest, SCHEMA), path).indexed == 40
    assert search.extend_search_index(spark.createDataFrame(rest, SCHEMA), path).indexed == 0
    whole = str(tmp_path / "whole")
    search.write_search_index(spark.createDataFrame(rows, SCHEMA), whole)
    grown, built = (search.read_search_index(spark, p, None) for p in (path, whole))
    assert hits(search.rank_chunks(grown, asked(spark), k=9)) == hits(search.rank_chunks(built, asked(spark), k=9))
    assert sorted(grown.lexical.postings.collect()) == sorted(built.lexical.postings.collect())


def test_changed_and_withdrawn_trials(spark, tmp_path):
    path, rows = str(tmp_path / "index"), texts(50)
    search.write_search_index(spark.createDataFrame(rows, SCHEMA), path)
    changed = [(c, n, i, "the w3 new text w59") for c, n, i, _ in rows[10:20]]
    # A trial that had one chunk now has two, one that is new, and some that go.
    changed += [("N10_chunk_1", "N10", 1, "second part w4"), ("N777_chunk_0", "N777", 0, "w58 the")]
    gone = spark.createDataFrame([(f"N{i}",) for i in range(5)] + [("N404",)], "nct_id string")
    for _ in range(2):  # repeated, it changes nothing
        search.replace_in_index(spark.createDataFrame(changed, SCHEMA), path, withdrawn=gone)
        found = search.read_search_index(spark, path, None)
        whole = str(tmp_path / f"whole{_}")
        search.write_search_index(spark.createDataFrame(rows[5:10] + rows[20:] + changed, SCHEMA), whole)
        built = search.read_search_index(spark, whole, None)
        for k in (3, 40):
            assert hits(search.rank_chunks(found, asked(spark), k=k)) == hits(search.rank_chunks(built, asked(spark), k=k))
            assert hits(search.rank_chunks(found, asked(spark), k=k, queries_at_most=5)) == hits(
                search.rank_chunks(built, asked(spark), k=k)
            )
        assert found.lexical.stats.first() == built.lexical.stats.first()
        assert sorted(map(tuple, found.lexical.frequencies.select("term", "df").collect())) == sorted(
            map(tuple, built.lexical.frequencies.select("term", "df").collect())
        )


def test_rejected_chunks_that_were_accepted_later(spark, tmp_path):
    def load(refuse):
        def make():
            def encode(texts):
                if refuse and "bad" in texts:
                    raise MemoryError
                return np.ones((len(texts), 2))

            return encode

        return make

    rows = [("N1_chunk_0", "N1", 0, "good"), ("N1_chunk_1", "N1", 1, "bad")]
    chunks, path = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index")
    assert search.extend_search_index(chunks, path, embedder=load(True)) == (1, 1)
    assert search.extend_search_index(chunks, path, embedder=load(True)) == (0, 1)
    assert search.extend_search_index(chunks, path, embedder=load(False)) == (1, 0)
    assert search.read_search_index(spark, path, None).chunks.count() == 2
    # Written anew, the index forgets earlier generations.
    assert search.write_search_index(chunks.limit(1), path, embedder=load(False)) == (1, 0)
    assert search.read_search_index(spark, path, None).chunks.count() == 1


def test_replacing_writes_the_chunks_once(spark, tmp_path, monkeypatch):
    names, plain = [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: names.append(name) or plain(df, name))
    columns = "chunk_id string, nct_id string, text string"
    path = str(tmp_path / "index")
    old = [("a0", "a", "red bolt"), ("b0", "b", "blue ring"), ("c0", "c", "old gear")]
    search.write_search_index(spark.createDataFrame(old, columns), path)
    gone = spark.createDataFrame([("c",), (None,)], "nct_id string")
    new = spark.createDataFrame([("a0", "a", "green plate"), ("d0", "d", "new bolt")], columns)
    counts = search.replace_in_index(new, path, withdrawn=gone)
    assert counts.indexed == 3 and "incoming" not in names
    left = search._stored(spark, path, rejected=False).select("chunk_id", "text").collect()
    assert sorted(map(tuple, left)) == [("a0", "green plate"), ("b0", "blue ring"), ("d0", "new bolt")]


def test_withdrawing_writes_no_terms(spark, tmp_path, monkeypatch):
    written, plain = {}, search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: written.setdefault(name, df.columns) and plain(df, name))
    path = str(tmp_path / "index")
    search.write_search_index(spark.createDataFrame(texts(30), SCHEMA), path)
    gone = spark.createDataFrame([("N3",), ("N4",), (None,)], "nct_id string")
    for key, left in (("nct_id", 28), ("chunk_id", 26)):
        names = gone if key == "nct_id" else spark.createDataFrame([("N8_chunk_0",), ("N9_chunk_0",)], "chunk_id string")
        fresh = spark.createDataFrame([], SCHEMA)
        assert search.replace_in_index(fresh, path, withdrawn=names, key=key).indexed == left
        assert "chunk_id" in written["withdrawn"] and "terms" not in written["withdrawn"]
    built = str(tmp_path / "built")
    search.write_search_index(spark.createDataFrame([r for r in texts(30) if r[1] not in ("N3", "N4", "N8", "N9")], SCHEMA), built)
    found, whole = (search.read_search_index(spark, p, None).lexical for p in (path, built))
    assert found.stats.first() == whole.stats.first()
    assert sorted(map(tuple, found.frequencies.collect())) == sorted(map(tuple, whole.frequencies.collect()))


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_lists_travel_in_pieces(spark, kind):
    """What a task holds for one file is one compressed row of the shuffle."""
    rows = [(i, f"{' '.join(['the'] * (i % 4))} w{i % 11} w{i}") for i in range(400)] + [(None, "the x")]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(3)
    index = lexical.build_lexical_index(chunks.withColumn("chunk_id", F.col("chunk_id").cast(kind)))
    dealt = lexical.deal_lists(index.lists, 2000.0, 5)
    plan = dealt._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning(_to" in plan.split("== Physical Plan ==")[1]
    listed = index.lists.select("term", "chunk_ids", "tfs", "dls")
    assert dealt.columns == ["term", "chunk_ids", "tfs", "dls", "_part"]
    assert sorted(map(str, dealt.drop("_part").collect())) == sorted(map(str, listed.collect()))
    places = dealt.select("term", F.spark_partition_id().alias("at")).distinct()
    assert places.count() == listed.select("term").distinct().count()
