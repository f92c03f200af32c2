"""Stored vectors, found again by the content of the text and the name of the model.

A request first looks its texts up and runs the model on those only that no earlier request
has met. Rows are keyed by a SHA-256 of the text and lie in folders by model and by the
first digit of that key. They are only ever added. Two requests at a time may store a text
twice, which readers see once; a request that fails stores nothing or some of its texts, and
what it stored is right. Texts that the model refuses are not stored and are tried again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from matchloom.functions.vectors import DEFAULT_DIM
from matchloom.operators.embedding import TOLERATED, Embedder, embed_column
from matchloom.operators.scale import is_small, lookup_join
from matchloom.storage import materialize


class EmbeddingCache(NamedTuple):
    """The folder of the stored vectors, and which model they come from.

    ``model`` names everything a vector depends on besides the text: model, version,
    dimension. Another name shares nothing with this one.
    """

    path: str
    model: str

    def stored(self, spark: SparkSession) -> DataFrame | None:
        """(model, part, hash, embedding) of this model, or None before the first request."""
        try:
            return spark.read.parquet(self.path).filter(F.col("model") == self.model)
        except AnalysisException:
            return None

    def add(self, vectors: DataFrame) -> None:
        """Store rows of (part, hash, embedding)."""
        named = vectors.withColumn("model", F.lit(self.model))
        named.write.mode("append").partitionBy("model", "part").parquet(self.path)


def embed_cached(
    df: DataFrame,
    text: str,
    cache: EmbeddingCache | None,
    *,
    embedder: Embedder | None = None,
    dim: int = DEFAULT_DIM,
    tolerate: tuple[type[BaseException], ...] = TOLERATED,
) -> DataFrame:
    """Adds ``embedding`` and ``error`` like :func:`embed_column`, by way of the cache.

    ``df`` has each text once. A null text has no key and goes to the model, as without
    a cache; without one, all texts do.
    """
    options = {"embedder": embedder, "dim": dim, "tolerate": tolerate}
    if cache is None:
        return embed_column(df, text, **options)
    spark = df.sparkSession
    key = F.sha2(F.col(text).cast("string"), 256)
    asked = df.withColumn("hash", key).withColumn("part", F.substring("hash", 1, 1))
    asked = materialize(asked, "asked")
    missing, parts = asked, []
    stored = cache.stored(spark)
    if stored is not None:
        # Few texts find theirs in one scan of what is stored; many meet it by a shuffle.
        few = is_small(asked)
        wanted = lookup_join(
            stored.select("hash", "embedding"), asked.select("hash").distinct(), ["hash"],
            how="left_semi", small_is_bounded=few,
        )
        looked_up = materialize(asked.join(wanted.dropDuplicates(["hash"]), "hash", "left"), "looked_up")
        found = looked_up.filter(F.col("embedding").isNotNull())
        parts.append(found.withColumn("error", F.lit(None).cast("string")).select(*df.columns, "embedding", "error"))
        missing = looked_up.filter(F.col("embedding").isNull()).drop("embedding")
        if missing.isEmpty():
            return parts[0]
    fresh = materialize(embed_column(missing, text, **options), "embedded")
    accepted = fresh.filter(F.col("error").isNull() & F.col("hash").isNotNull())
    cache.add(accepted.select("part", "hash", "embedding"))
    parts.append(fresh.select(*df.columns, "embedding", "error"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
