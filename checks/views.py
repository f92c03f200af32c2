"""The driver's tables seen as patients, conditions and studies.

The same SQL text runs on Spark and, as common table expressions, on DuckDB. Every
view covers the whole of its base tables: a modulo only spreads one table's keys
over all keys of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "part", "orders", "documents", "embeddings", "benchmark")

VIEWS = {
    "patients": """
        SELECT c_custkey AS patient_id, CAST(18 + c_custkey % 73 AS INT) AS age,
               CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               c_mktsegment AS race, r_name AS ethnicity, c_name AS name
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "patient_conditions": """
        SELECT o_orderkey AS id, o_custkey AS patient_id, p_name AS conditions
        FROM (SELECT o_orderkey, o_custkey,
                     o_orderkey % (SELECT count(*) FROM part) AS part_no FROM orders) o
        JOIN part ON p_partkey = part_no""",
    "studies": """
        SELECT concat('NCT', CAST(doc_id AS STRING)) AS nct_id, doc_id,
               concat('Title: ', a.p_name, ' study ', CAST(doc_id AS STRING),
                 chr(10), 'Eligibility:', chr(10), 'Inclusion Criteria: ', text,
                 chr(10), 'Exclusion Criteria: prior ', b.p_name,
                 chr(10), 'Conditions: ', a.p_name, ', ', b.p_name,
                 chr(10), 'Locations: ', source,
                 chr(10), 'Interventions: ', a.p_brand,
                 chr(10), 'Outcomes:', chr(10), '- PRIMARY: change in ', a.p_name,
                 chr(10), '- SECONDARY: safety of ', b.p_name,
                 chr(10), '- SECONDARY: ', lang) AS document,
               text AS body, a.p_name AS condition_1, b.p_name AS condition_2,
               concat(a.p_name, ', ', b.p_name) AS conditions,
               lang AS phase, source AS status,
               CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars END AS enrollment,
               CASE WHEN doc_id % 5 = 0 THEN 'NA'
                    WHEN doc_id % 7 = 0 THEN concat(CAST(18 + doc_id % 20 AS STRING), ' Years')
                    ELSE CAST(18 + doc_id % 20 AS STRING) END AS minimum_age,
               CASE WHEN doc_id % 6 = 0 THEN ''
                    ELSE CAST(50 + doc_id % 30 AS STRING) END AS maximum_age
        FROM (SELECT *, doc_id % (SELECT count(*) FROM part) AS part_a,
                     (doc_id * 7) % (SELECT count(*) FROM part) AS part_b FROM documents) d
        JOIN part a ON a.p_partkey = part_a
        JOIN part b ON b.p_partkey = part_b""",
    "queries": """
        SELECT item_id AS query_id, text AS query FROM benchmark""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter view, or a base table, over the parquet files of ``sf_dir``."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {t: view(spark, sf_dir, t) for t in BASE_TABLES if f" {t}" in VIEWS[name]}
    sql = VIEWS[name]
    for table in tables:
        sql = _named(sql, table)
    return spark.sql(sql, **tables)


def _named(sql: str, table: str) -> str:
    """Refer to a DataFrame argument of ``spark.sql`` instead of a catalog table."""
    for keyword in ("FROM", "JOIN"):
        sql = sql.replace(f"{keyword} {table} ", f"{keyword} {{{table}}} ")
        sql = sql.replace(f"{keyword} {table})", f"{keyword} {{{table}}})")
        if sql.endswith(f"{keyword} {table}"):
            sql = sql.removesuffix(table) + f"{{{table}}}"
    return sql
