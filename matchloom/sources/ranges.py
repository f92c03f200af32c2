"""One JSON map of any size, read by many tasks.

A file ``{"key": {...}, "key": {...}}`` is cut at every closing brace, wherever it stands, so
byte ranges of the file are independent scans. Whether such a brace ends a record depends on
what comes before: being inside a string, and how deep. Each range is therefore first summed
up as a transition (does it flip the string state; how does the depth change if it starts
outside, or inside, a string), the transitions of a file are combined in order, and the
records are then cut with the state known at the start of every range. A record across the
border of ranges comes in fragments, at most two a range, that are put together by a group.

A file that does not end as it should raises. No spelling is assumed: texts may hold braces,
quotes and separators, records may be compact or indented, and fields come in any order.
The file is read three times, and its text reaches Python twice.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Text of finished records handed on at once.
BATCH_CHARS = 4_000_000


def map_records(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the records of the maps at ``path``, each as a map of its own.

    A range is what ``spark.sql.files.maxPartitionBytes`` gives to a task.
    """
    pieces = _pieces(spark, path)
    # One small row for each range but a file's first, so a millionth of the file.
    starts = F.broadcast(_range_starts(pieces).filter("start > 0"))
    known = pieces.join(starts, ["file", "start"], "left").select(
        "file", "start", "value", "flips", "outside", "inside",
        F.coalesce("in_string", F.lit(False)).alias("in_string"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    schema = "file string, start bigint, part int, opens int, text string"
    whole = known.mapInArrow(_cut(fragments=False), schema).select("text")
    parts = known.mapInArrow(_cut(fragments=True), schema)
    in_order = Window.partitionBy("file").orderBy("start", "part")
    joined = (
        parts.withColumn("record", F.sum("opens").over(in_order))
        .groupBy("file", "record")
        .agg(F.array_sort(F.collect_list(F.struct("start", "part", "text"))).alias("parts"))
        .select(F.array_join(F.col("parts.text"), "").alias("text"))
    )
    bare = F.regexp_replace("text", r"^[\s{,]+", "")
    return whole.unionByName(joined).select(F.concat(F.lit("{"), bare, F.lit("}")).alias("value"))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between closing braces, in file order inside a range, and what it does.

    An escape never stands across a brace, since ``\\}`` is none.
    """
    text = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    plain = F.regexp_replace("value", r"\\.", "")
    return text.select(
        "file", "start", "value",
        (F.regexp_count(plain, F.lit('"')) % 2 == 1).alias("flips"),
        _opened(plain).alias("outside"),
        _opened(F.regexp_replace(plain, r'^[^"]*("|$)', "")).alias("inside"),
    )


def _opened(plain: Column) -> Column:
    """Opening braces outside strings."""
    return F.regexp_count(F.regexp_replace(plain, r'"[^"]*("|$)', ""), F.lit(r"\{"))


def _range_starts(pieces: DataFrame) -> DataFrame:
    """(file, start, in_string, depth): the state in which every range begins."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a range does if it starts outside (row 0) or inside (row 1) a string.
        done: dict[tuple, list] = {}
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("file", "start", "flips", "outside", "inside")]
            for file, start, flips, *opens in zip(*columns):
                state = done.setdefault((file, start), [[False, 0], [True, 0]])
                for s in state:
                    s[1] += opens[s[0]]
                    s[0] ^= flips
                    s[1] -= not s[0]
        rows = [(*key, a[0], a[1], b[1]) for key, (a, b) in done.items()]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("file", "start", "flips", "outside", "inside"), r)) for r in rows], schema=arrow
        )

    names = ["file", "start", "flips", "outside", "inside"]
    arrow = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))))
    schema = "file string, start bigint, flips boolean, outside bigint, inside bigint"
    ranges = pieces.select(*names).mapInArrow(sum_up, schema)

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        in_string, depth, states = False, 0, []
        for flips, outside, inside in zip(rows["flips"], rows["outside"], rows["inside"]):
            states.append((in_string, depth))
            depth += inside if in_string else outside
            in_string ^= bool(flips)
        # What follows the last brace, as a line's end, counts as one more piece.
        if in_string or depth not in (0, -1):
            raise ValueError(f"not a whole JSON map: {rows['file'].iloc[0]}")
        rows["in_string"], rows["depth"] = zip(*states)
        return rows[["file", "start", "in_string", "depth"]]

    return ranges.groupBy("file").applyInPandas(combine, "file string, start bigint, in_string boolean, depth int")


def _cut(*, fragments: bool):
    """A task function that yields the whole records of its ranges, or the fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows, size = None, [], [], 0
        in_string, depth, closing = False, 0, False
        for batch in batches:
            for r in zip(*(batch.column(n).to_pylist() for n in batch.schema.names)):
                file, start, value, flips, outside, inside, *state = r
                if (file, start) != key:
                    if key and fragments and not _blank(held):
                        rows.append((*key, 1 - closing, int(not closing), "".join(held)))
                    key, held, (in_string, depth) = (file, start), [], state
                    # A range that starts within a record first ends that one.
                    closing = in_string or depth > 1
                depth += inside if in_string else outside
                in_string ^= flips
                depth -= not in_string
                held.append(value)
                if in_string or depth > 1:
                    held.append("}")
                    continue
                if depth == 1:
                    held.append("}")
                if not _blank(held) and fragments == closing:
                    text = "".join(held)
                    rows.append((*key, 0, 0, text))
                    size += len(text)
                held, closing = [], False
                if size > BATCH_CHARS:
                    yield _batch(rows)
                    rows, size = [], 0
        if key and fragments and not _blank(held):
            rows.append((*key, 1 - closing, int(not closing), "".join(held)))
        if rows:
            yield _batch(rows)

    return run


def _blank(held: list[str]) -> bool:
    return all(not text.strip(" \t\r\n{,") for text in held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "start": pa.int64(), "part": pa.int32(), "opens": pa.int32(), "text": pa.string()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds)
    )
