"""Reading the input tables, with the checks a loader owes its callers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators.quality import keep_first_by_key, project_metadata
from matchloom.functions.text import joined_numbered_fields, lenient_int, numbered_fields
from matchloom.sources.ranges import map_records

# Column names of the input files.
DEMOGRAPHICS_COLUMNS = (
    "patient_id",
    "name",
    "age",
    "gender",
    "marital",
    "race",
    "ethnicity",
    "ssn",
    "address",
)
CONDITIONS_COLUMNS = ("patient_id", "conditions")

TRIAL_SCHEMA = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("document", T.StringType()),
            T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        ]
    ),
)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def with_file_order(df: DataFrame) -> DataFrame:
    """Adds (file_path, row_index): the place of a row in its parquet input.

    Unlike a generated id this is the same on every read and every task attempt, so
    "keep the first" has one answer.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.row_index").alias("row_index"),
    )


def load_demographics(spark: SparkSession, *paths: str, file_order: bool = False) -> DataFrame:
    df = spark.read.parquet(*paths)
    require_columns(df, DEMOGRAPHICS_COLUMNS)
    if file_order:
        df = with_file_order(df)
        return df.select(*DEMOGRAPHICS_COLUMNS, "file_path", "row_index")
    return df.select(*DEMOGRAPHICS_COLUMNS)


def load_conditions(spark: SparkSession, *paths: str) -> DataFrame:
    df = require_columns(spark.read.parquet(*paths), CONDITIONS_COLUMNS)
    return df.select(*CONDITIONS_COLUMNS)


def load_trials(spark: SparkSession, path: str, layout: str = "object") -> DataFrame:
    """(nct_id, document, metadata) from JSON maps ``nct_id -> {document, metadata}``.

    Layouts:
      ``lines``   each line is a map, usually of one record; splits freely;
      ``object``  one map per file, parsed whole by one task per file;
      ``split``   one map per file, read by many tasks: see :mod:`matchloom.sources.ranges`.

    The layout is the caller's choice and never follows from a file's size, so a file
    reads alike however large it is.
    """
    if layout == "lines":
        text = spark.read.text(path).filter(F.trim("value") != "")
    elif layout == "object":
        text = spark.read.text(path, wholetext=True)
    elif layout == "split":
        text = map_records(spark, path)
    else:
        raise ValueError("layout is 'lines', 'object' or 'split'")
    parsed = text.select(
        F.from_json("value", TRIAL_SCHEMA, {"mode": "FAILFAST"}).alias("records")
    )
    return parsed.select(F.explode("records").alias("nct_id", "record")).select(
        "nct_id",
        F.coalesce("record.document", F.lit("")).alias("document"),
        F.coalesce(
            "record.metadata", F.create_map().cast("map<string,string>")
        ).alias("metadata"),
    )


def trial_table(source: DataFrame) -> DataFrame:
    """Loaded trials as a table, the known metadata keys promoted to columns.

    ``conditions`` is the comma-joined text, ``condition_list`` the same as an array.
    """
    meta = F.col("metadata")
    return source.select(
        "nct_id",
        F.col("document").alias("text"),
        joined_numbered_fields(meta, "condition_", "conditions_count").alias("conditions"),
        numbered_fields(meta, "condition_", "conditions_count").alias("condition_list"),
        *[meta[k].alias(k) for k in ("phase", "status", "minimum_age", "maximum_age")],
        lenient_int(meta["enrollment"]).alias("enrollment"),
        project_metadata("metadata").alias("metadata"),
    )


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A relational table, read by ``partitions`` parallel range queries."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return reader.options(**(properties or {})).load()


def clean_demographics(df: DataFrame) -> DataFrame:
    """Demographics as a store would keep them: whole rows, unique, first key wins.

    ``df`` comes from :func:`load_demographics` with ``file_order=True``.
    """
    complete = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in DEMOGRAPHICS_COLUMNS))
    first = keep_first_by_key(complete, ["patient_id"], ["file_path", "row_index"])
    return first.drop("file_path", "row_index")
