"""Compressed vectors: recall of ordinary queries, and exactness with full effort."""

import numpy as np
from pyspark.sql import functions as F

from checks.spark_queries import REGISTRY
from matchloom.operators import quantized
from matchloom.operators.similarity import top_k_by_dot
from matchloom.storage import new_table_path


def test_recall_of_ordinary_queries(spark):
    for sf in ("sf0.01", "sf0.1"):
        found = REGISTRY["ann_quantized_recall"](spark, f"/root/testdata/{sf}").toPandas()
        assert found["recall"].mean() >= 0.9
        assert found["rows_listed"].max() < found["rows_all"].max() / 2


def test_full_effort_is_exact(spark):
    random = np.random.default_rng(0)
    rows = [(int(i), random.normal(size=10).tolist()) for i in range(300)] + [(900, None)]
    corpus = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    quantizer = quantized.train_quantizer(corpus, 4, parts=3, entries=8)
    path = new_table_path(spark, "q")
    quantized.write_index(corpus, quantizer, path)
    index = quantized.read_index(spark, path, quantizer)
    queries = corpus.filter("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), "embedding")
    key = lambda df: sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))
    exact = key(top_k_by_dot(queries, corpus.filter("embedding IS NOT NULL"), 5))
    assert key(quantized.top_k(queries, index, 5, quantized.Effort(4, 300, 1.0))) == exact
    assert index.codes.count() == 300
    few = quantized.top_k(queries, index, 5, quantized.Effort(1, 5, 0.0))
    assert few.groupBy("query_id").count().agg(F.max("count")).scalar() is not None
    assert quantized.top_k(queries.limit(0), index, 5, quantized.Effort(1, 5, 0.0)).count() == 0
