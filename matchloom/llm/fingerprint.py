"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``k`` smallest distinct 64-bit hashes of a text's shingles of five
words. Sketches of parts merge to the sketch of the whole, and two sketches estimate
resemblance, containment and distinct shingle counts. Everything is a column expression.

Defined cases: a null text is an empty one; an empty text has an empty sketch; fewer
than five words form one shingle; two empty sketches resemble each other fully (equal
texts do), an empty and a non-empty one not at all. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SKETCH_SIZE = 128
# The characters [\x20\x09-\x0D] that separate words.
BLANKS = " \t\n\x0b\x0c\r"
# Blocks of neighbouring ids per shuffle partition, and their largest number.
BLOCKS_PER_PARTITION = 4
MAX_BLOCKS = 1 << 16
# Text of a block, beyond that number of blocks per partition.
BLOCK_BYTES = 1 << 26
LOWEST = -(1 << 63)


def words(text: Column) -> Column:
    """Words between blanks, in order; none for an empty text."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )


def with_sketch(
    df: DataFrame, text: str, out: str, k: int = SKETCH_SIZE, size: int = SHINGLE_WORDS
) -> DataFrame:
    """``df`` with the bottom-k sketch of column ``text`` as an array of longs.

    Words are hashed once; a shingle's hash is taken from its words' hashes.
    """
    hashes = F.col("_word_hashes")
    shingles = (
        F.when(F.size(hashes) == 0, F.array().cast("array<bigint>"))
        .when(F.size(hashes) < size, F.array(F.xxhash64(hashes)))
        .otherwise(
            F.transform(
                F.slice(hashes, F.lit(1), F.size(hashes) - (size - 1)),
                lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, size)]),
            )
        )
    )
    return (
        df.withColumn("_word_hashes", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
        .withColumn("_shingles", shingles)
        .withColumn(out, F.slice(F.sort_array(F.array_distinct("_shingles")), 1, k))
        .drop("_word_hashes", "_shingles")
    )


def merge(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` holds."""
    held = resemblance(a, b, k)
    overlap = held / (1 + held) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    size = distinct_shingles(a, k)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), overlap / size))


def distinct_shingles(sketch: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    span = (F.element_at(sketch, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(
        F.lit(float(k - 1)) / span
    )


def encode(sketch: Column) -> Column:
    """Sixteen hexadecimal digits per hash, smallest hash first."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def id_block(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at or below ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= len(bounds)) & (F.get(table, low + step - 1) <= key), low + step
        ).otherwise(low),
    )


def _pieces(cuts: list[int]) -> tuple[list[int], dict[int, int]]:
    """Bounds of blocks of ids, and into how many pieces the block of a hot id is cut.

    An id that several ascending cuts name holds as many shares of all rows; its block
    then has no other id.
    """
    cuts = sorted(cuts)
    hot = {v: cuts.count(v) + 1 for v in set(cuts) if cuts.count(v) > 1}
    bounds = sorted(set(cuts) | {v + 1 for v in hot if v < (1 << 63) - 1})
    return bounds, {bounds.index(v) + 1: n for v, n in hot.items()}


def _merged(rows: DataFrame, hot: list[int]) -> DataFrame:
    """``rows`` with ``_n``: equal rows of a hot id are one row that counts them."""
    if not hot:
        return rows.withColumn("_n", F.lit(1).cast("bigint"))
    edge = rows.sparkSession.createDataFrame([(v,) for v in hot], "_key bigint")
    few = rows.join(F.broadcast(edge), "_key", "left_semi")
    rest = rows.join(F.broadcast(edge), "_key", "left_anti")
    counted = few.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    return rest.withColumn("_n", F.lit(1).cast("bigint")).unionByName(counted)


def with_next(docs: DataFrame, k: int = SKETCH_SIZE) -> DataFrame:
    """Each document with the text and sketch of the one that follows by descending id.

    After the last comes the first. Equal ids follow in descending order of their text's
    hash, then of text; null ids come last. Rows are cut into blocks of about equal size, so
    the order needs no task that sees all: only the first row of a block travels to another
    block. An id that holds many rows has pieces by the hash, and its equal rows travel as
    one.
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id"), F.lit(LOWEST)).alias("_key"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("_tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(MAX_BLOCKS, max(BLOCKS_PER_PARTITION * partitions, size // BLOCK_BYTES + 1))
    cuts = [i / blocks for i in range(1, blocks)]
    found = rows.agg(F.percentile_approx("_key", cuts, 10 * max(1000, blocks))).first()[0]
    bounds, pieces = _pieces(found or [])
    rows = _merged(rows, [bounds[b - 1] for b in pieces])
    numbers = [pieces.get(b, 1) for b in range(len(bounds) + 1)]
    of = F.get(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>"), F.col("_block"))
    # Rounding keeps the order, so a piece holds a range of hashes.
    share = F.floor((F.col("_tie") / F.lit(2.0**64) + 0.5) * of).cast("int")
    rows = rows.withColumn("_block", id_block(F.col("_key"), bounds)).withColumn(
        "_piece", F.least(share, of - 1)
    )
    # One row per block: at most twice MAX_BLOCKS rows of numbers reach the driver.
    first = F.max(F.struct("_key", "_tie")).alias("_first")
    firsts = sorted(rows.groupBy("_block", "_piece").agg(first).collect(), reverse=True)
    follows = [(r[0], r[1], *firsts[(i + 1) % len(firsts)][2]) for i, r in enumerate(firsts)]
    edge = spark.createDataFrame(follows, "_block int, _piece int, _key bigint, _tie bigint")
    edges = with_sketch(
        rows.select("_key", "_tie", "text")
        .join(F.broadcast(edge), ["_key", "_tie"])
        .groupBy("_block", "_piece")
        .agg(F.max("text").alias("_edge_text")),
        "_edge_text",
        "_edge_sketch",
        k,
    )
    order = W.partitionBy("_block", "_piece").orderBy(F.desc("_key"), F.desc("_tie"), F.desc("text"))
    inside = (
        with_sketch(rows, "text", "sketch", k)
        .withColumn("_next_text", F.lead("text").over(order))
        .withColumn("_next_sketch", F.lead("sketch").over(order))
    )
    out = inside.join(edges, ["_block", "_piece"], "left").select(
        "doc_id",
        "text",
        "sketch",
        F.coalesce("_next_text", "_edge_text").alias("next_text"),
        F.coalesce("_next_sketch", "_edge_sketch").alias("next_sketch"),
        "_n",
    )
    if not pieces:
        return out.drop("_n")
    # Of equal rows, each but the last is followed by its equal.
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_i")
    last = F.col("_i") == F.col("_n")
    return out.select("*", again).select(
        "doc_id",
        "text",
        "sketch",
        F.when(last, F.col("next_text")).otherwise(F.col("text")).alias("next_text"),
        F.when(last, F.col("next_sketch")).otherwise(F.col("sketch")).alias("next_sketch"),
    )


def fingerprint_edits(docs: DataFrame, k: int = SKETCH_SIZE) -> DataFrame:
    """Fingerprint of each text and of its edited text, with their likeness.

    The edited text replaces the last third of the code points (rounded down) by the
    first as many of the next document, or all it has. One row per input row.
    """
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - third),
        F.substring(F.col("next_text"), F.lit(1), third),
    )
    rows = with_sketch(with_next(docs, k).withColumn("edited", edited), "edited", "_edited", k)
    return rows.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("_edited")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("_edited"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("sketch"), F.col("_edited"), k).alias("contained_in_edited"),
    )
