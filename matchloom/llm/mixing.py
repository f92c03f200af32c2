"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target is its share of all words by weight, at most ``cap`` times what it
has. A document is taken ``target / source size`` times on average: the whole part for
sure, the rest by chance. Two documents at a time exchange word mass, which keeps the
source's total, until the chance of one is 0 or 1; which way the mass goes is drawn so that
every chance keeps its mean. The open one meets the next, and what is left undecided in one
group meets the residuals of other groups in a reduction tree, down to one document a
source. One group of each source waits for that last level. There the last open document is
drawn, and what this adds or takes is made up for by decided ones, larger ones first: totals
come as near their targets as the smallest of them allow, at the cost of the equal chance of
those few.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of
its own, ranked last; repeated rows are separate documents, dealt out over groups like
others; an empty table gives no rows; extra columns are ignored. Draws depend on the seed
and the rows alone.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.operators.scale import BROADCAST_ROWS
from matchloom.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAP = 3.0
WEIGHTS = (1, 2, 3)
# Documents that one task rounds together, and residuals that meet in one tree node.
GROUP_ROWS = 4096
FAN_IN = 256


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, the number of words of each text and a hash of it."""
    trimmed = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    n = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")))
    return docs.select(
        "doc_id", "source", n.cast("bigint").alias("size"), F.xxhash64("text").alias("text_hash")
    )


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP
) -> DataFrame:
    """source, n_docs, source_size and target, one row per source.

    Resharing what exceeds a cap until none does fills all uncapped sources to one level
    of words per weight. Sources sorted by their cap per weight are capped up to the
    first whose cap the level does not reach.
    """
    totals = sizes.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("size").alias("source_size")
    )
    # One row per source from here on.
    rank = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), rank % len(weights))
    ratio = W.orderBy("_ratio", F.asc_nulls_last("source"))
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.col("_weights") - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    filled = (
        totals.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_weights", F.sum("_weight").over(everything))
        .withColumn("_level", level)
        .withColumn("_place", F.row_number().over(ratio))
        # The level at the first source that stays below its cap holds for all after it.
        .withColumn(
            "_level",
            F.min_by("_level", F.when(F.col("_level") <= F.col("_ratio"), F.col("_place"))).over(
                everything
            ),
        )
    )
    target = F.least("_cap", F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap")))
    return filled.select("source", "n_docs", "source_size", target.alias("target"))


def _settle(sizes: np.ndarray, chances: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Round chances, keeping the sum of chance times size; at most one stays open.

    ``sizes`` come in descending order, so documents of like sizes meet.
    """
    size, chance = sizes.tolist(), chances.tolist()
    draws = random.random(len(size)).tolist()
    i = None
    for j, y in enumerate(chance):
        if not 0.0 < y < 1.0:
            continue
        if i is None:
            i = j
            continue
        x, a, b = chance[i], size[i], size[j]
        gain, loss = min((1 - x) * a, y * b), min(x * a, (1 - y) * b)
        if draws[j] * (gain + loss) < loss:
            chance[i] = 1.0 if gain == (1 - x) * a else x + gain / a
            chance[j] = 0.0 if gain == y * b else y - gain / b
        else:
            chance[i] = 0.0 if loss == x * a else x - loss / a
            chance[j] = 1.0 if loss == (1 - y) * b else y + loss / b
        # Whichever is open goes on; rounding errors may leave none.
        i = next((k for k in (i, j) if 0.0 < chance[k] < 1.0), None)
    return np.array(chance)


def _close(sizes: np.ndarray, chances: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Draw the last open document and make up for the difference with decided ones."""
    out = chances.copy()
    open_ = np.flatnonzero((out > 0) & (out < 1))
    if not len(open_):
        return out
    k = open_[0]
    drawn = float(random.random() < chances[k])
    tries = []
    for end in (drawn, 1 - drawn):
        one = out.copy()
        one[k] = end
        excess = sizes[k] * (end - chances[k])
        for j in range(len(one)):  # descending sizes
            # Taking out, or in, a document no larger than what is over, or missing.
            change = sizes[j] if one[j] == 1 else -sizes[j]
            if j != k and excess and change and 0 < change / excess <= 1:
                one[j] = 1 - one[j]
                excess -= change
        tries.append((abs(excess), one))
    # As drawn, unless the others cannot make up for that.
    (error, one), (other_error, other) = tries
    return other if other_error + sizes[sizes > 0].min() < error else one


def _round_group(seed: int, level: int, last: bool):
    def settle(group: pd.DataFrame) -> pd.DataFrame:
        if not last and group["_node"].iloc[0] == 0:
            return group  # waits for the last level, to make up for what comes there
        # Large documents first, so that what stays open is small.
        group = group.sort_values(
            ["size", "doc_id", "text_hash", "copy"], ascending=[False, True, True, True]
        )
        source = group["source"].iloc[0]
        key = "" if source is None or pd.isna(source) else f"s{source}"
        node = int(group["_node"].iloc[0])
        # The draw is a function of seed, level, node and source.
        words = np.frombuffer(f"{seed}|{level}|{node}|{key}".encode(), np.uint8)
        random = np.random.default_rng(words.astype(np.uint32))
        words = group["size"].to_numpy(float)
        out = _settle(words, group["chance"].to_numpy(float), random)
        if last:
            out = _close(words, out, random)
        return group.assign(chance=out)

    return settle


def _numbered(sizes: DataFrame, block: int = 4096) -> DataFrame:
    """``sizes`` with ``copy``, a number among equal rows.

    Equal rows become one with a count, which then gives blocks, and blocks rows, so that
    no task makes an unbounded number of copies.
    """
    counted = sizes.groupBy(*sizes.columns).agg(F.count("*").alias("_n"))
    some = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block))))
    if not counted.filter(F.col("_n") > block).isEmpty():
        some = some.repartition("doc_id", "text_hash", "_block")
    rest = F.least(F.lit(block).cast("bigint"), F.col("_n") - F.col("_block") * block)
    step = F.explode(F.sequence(F.lit(0).cast("bigint"), rest - 1))
    return some.withColumn("_step", step).select(
        *sizes.columns, (F.col("_block") * block + F.col("_step")).alias("copy")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: float = CAP,
    seed: int = 7,
    group_rows: int = GROUP_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, text_hash; a row per input row."""
    sizes = materialize(_numbered(document_sizes(docs)), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, cap), "mix-targets")
    small = targets.count() <= BROADCAST_ROWS
    share = F.col("target") / F.col("source_size")
    rows = (
        sizes.join(
            F.broadcast(targets) if small else targets,
            sizes["source"].eqNullSafe(targets["source"]),
        )
        .drop(targets["source"])
        .withColumn("_rate", F.when(F.col("source_size") > 0, share).otherwise(F.lit(0.0)))
        .withColumn("_whole", F.floor("_rate").cast("bigint"))
        .withColumn("chance", F.when(F.col("size") > 0, F.col("_rate") - F.col("_whole")).otherwise(0.0))
        .withColumn("_nodes", F.ceil(F.col("n_docs") / group_rows).cast("bigint"))
        .withColumn("_node", F.pmod(F.xxhash64("doc_id", "text_hash", "copy", F.lit(seed)), "_nodes"))
        .drop("n_docs")
    )
    widest = targets.agg(F.max(F.ceil(F.col("n_docs") / group_rows))).first()[0] or 1
    parts, level = [], 0
    while True:
        last = widest <= 1
        rows = materialize(
            rows.groupBy("source", "_node").applyInPandas(
                _round_group(seed, level, last), rows.schema
            ),
            f"mix-level{level}",
        )
        open_row = (F.col("chance") > 0) & (F.col("chance") < 1)
        parts.append(rows.filter(~open_row))
        if last:
            break
        widest, level = -(-widest // fan_in), level + 1
        rows = rows.filter(open_row).withColumn(
            "_node", F.floor(F.col("_node") / fan_in).cast("bigint")
        )
    settled = parts[0]
    for part in parts[1:]:
        settled = settled.unionByName(part)
    copies = F.col("_whole") + F.col("chance").cast("bigint")
    return settled.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source",
        "text_hash",
    )
