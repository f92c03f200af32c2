"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``. Labels come from ``labels`` in ``sf_dir``.

Defined cases: rows with null or empty texts pass the filters that do not reject them and
end as sequences' single end ids; an empty table stays empty; columns beyond those of
``documents`` are dropped; a document taken n times by the mix is n rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm import jaccard, mixing, packing, quality, substring
from matchloom.storage import materialize, new_table_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = quality.classify(docs.select(*COLUMNS), labels)
    return scored.filter("predicted = 1").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id.

    Rows without an id are kept. Rows that repeat an id are documents of their own, so only
    copies go. Documents without words are alike to nothing and stay.
    """
    rows = docs.select(*COLUMNS)
    several = rows.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("doc_id is not null and _n > 1")
    if several.isEmpty():
        copies = (
            jaccard.similar_components(rows)
            .filter("n_shingles > 0 and component_id <> doc_id")
            .select("doc_id")
        )
        return rows.join(copies.distinct(), "doc_id", "left_anti").select(*COLUMNS)
    # Written with a number per row, by which rows of one id are told apart.
    number = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_row", number), "numbered")
    found = jaccard.similar_components(rows.select(F.col("_row").alias("doc_id"), "text")).filter("n_shingles > 0")
    found = materialize(found.select(F.col("doc_id").alias("_row"), "component_id"), "numbered-groups")
    first = (
        rows.select("_row", "doc_id").join(found, "_row")
        .groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("_first"))
    )
    copies = found.join(first, "component_id").filter("_row <> _first._row").select("_row")
    return rows.join(copies, "_row", "left_anti").select(*COLUMNS)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of words that occur more than once; other texts as they are."""
    found = substring.remove_repeats(docs.select(*COLUMNS), as_is=True)
    changed = F.col("n_removed") > 0
    n_chars = F.when(changed, F.char_length("kept")).otherwise(F.col("doc.n_chars"))
    text = F.when(changed | (F.col("kept") != ""), F.col("kept"))
    return found.select(
        "doc.doc_id", text.alias("text"), "doc.lang", "doc.source",
        n_chars.cast("bigint").alias("n_chars"),
    )


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    keys = ["doc_id", "source", "text_hash"]
    taken = materialize(
        mixing.mix_sources(docs).groupBy(*keys)
        .agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
        .filter("_sum > 0"),
        "taken",
    )
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))

    def matched(part: DataFrame) -> DataFrame:
        same = [rows[k].eqNullSafe(part[k]) for k in keys]
        # One row per document: too many to broadcast, however few there are now.
        return rows.join(part.hint("merge"), same[0] & same[1] & same[2]).select(
            *[rows[c] for c in COLUMNS], rows["text_hash"], "_sum", "_rows"
        )

    times = matched(taken.filter("_rows = 1")).withColumn("_times", F.col("_sum"))
    several = taken.filter("_rows > 1")
    if not several.isEmpty():  # equal rows share what the mix takes of them
        place = F.row_number().over(W.partitionBy(*keys).orderBy("lang", "n_chars"))
        share = F.floor(F.col("_sum") / F.col("_rows")) + (place <= F.col("_sum") % F.col("_rows")).cast("int")
        times = times.unionByName(matched(several).withColumn("_times", share.cast("bigint")))
    copies = F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))
    return times.filter("_times > 0").withColumn("_copy", copies).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", reject_low_quality),
    ("near_copies", drop_near_copies),
    ("passages", remove_repeated_passages),
    ("mix", mix_to_weights),
    ("pack", pack_sequences),
]

# The classifier's training and the seeded mix cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = new_table_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
