"""Filters that each request brings itself, worked out while rows are scored.

A task that scores rows for many requests also reads the few columns the filters look at.
For each block of rows it makes a bitmap, rows by distinct filters, and takes each request's
column of it. So any number of different filters costs one pass over the rows, and a plan
does not grow with them.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class RequestFilters(NamedTuple):
    """Columns of the requests, each with the column of the rows it restricts.

    An ``equal`` column asks for exactly its value (null or empty: no restriction); a row
    without a value is not equal to any. An ``at_least`` column asks for its value or more
    (null or 0: no restriction); a row without a value counts as 0.
    """

    equal: tuple[tuple[str, str], ...]  # (column of requests, column of rows)
    at_least: tuple[tuple[str, str], ...]

    def asked(self, requests: DataFrame) -> list:
        """The requests' columns, as select list; types are those :meth:`bitmap` takes."""
        return [F.col(q).cast("string").alias(f"_ask_{q}") for q, _ in self.equal] + [
            F.col(q).cast("bigint").alias(f"_ask_{q}") for q, _ in self.at_least
        ]

    def looked_at(self) -> list:
        """The rows' columns that filters look at, as select list."""
        return [F.col(r).cast("string").alias(f"_of_{r}") for _, r in self.equal] + [
            F.col(r).cast("bigint").alias(f"_of_{r}") for _, r in self.at_least
        ]

    def from_pandas(self, rows: pd.DataFrame, prefix: str) -> pa.Table:
        """Those columns of a pandas group as Arrow: numbers with gaps are whole again."""
        side = 0 if prefix == "_ask_" else 1
        kinds = [(pair[side], pa.string()) for pair in self.equal]
        kinds += [(pair[side], pa.int64()) for pair in self.at_least]
        return pa.table(
            {f"{prefix}{n}": pa.array(rows[f"{prefix}{n}"], kind, from_pandas=True) for n, kind in kinds}
        )

    def distinct(self, asked: pa.Table) -> "DistinctFilters":
        """The distinct filters among requests, and which of them each request has."""
        names = [f"_ask_{q}" for q, _ in (*self.equal, *self.at_least)]
        rows = list(zip(*(asked.column(n).to_pylist() for n in names)))
        split = len(self.equal)
        plain = [tuple(v or None for v in r[:split]) + tuple(v or 0 for v in r[split:]) for r in rows]
        known = {f: i for i, f in enumerate(dict.fromkeys(plain))}
        return DistinctFilters(self, list(known), np.array([known[r] for r in plain], np.int64))


class DistinctFilters(NamedTuple):
    columns: RequestFilters
    filters: list[tuple]
    of_request: np.ndarray

    def allowed(self, rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        """(rows, requests): whether the request's filter lets the row through."""
        bitmap = np.ones((rows.num_rows, len(self.filters)), bool)
        parts = list(zip(*self.filters))
        for values, (_, name) in zip(parts, self.columns.equal):
            wanted = list(dict.fromkeys(v for v in values if v is not None))
            number = {v: i for i, v in enumerate(wanted)}
            found = pc.index_in(_one(rows.column(f"_of_{name}")), value_set=pa.array(wanted, pa.string()))
            found = found.fill_null(-1).to_numpy(zero_copy_only=False)
            code = np.array([-2 if v is None else number[v] for v in values])
            bitmap &= (code == -2) | (found[:, None] == code)
        for values, (_, name) in zip(parts[len(self.columns.equal) :], self.columns.at_least):
            least = np.array(values, np.int64)
            found = _one(rows.column(f"_of_{name}")).fill_null(0).to_numpy(zero_copy_only=False)
            bitmap &= (least == 0) | (found[:, None] >= least)
        return bitmap[:, self.of_request]


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
