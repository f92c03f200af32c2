"""Vector algebra on ``ARRAY<FLOAT>`` columns and the default text embedder.

These expressions suit one pair per row. All-against-all work goes through the
block kernels in :mod:`matchloom.operators.similarity`.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.text import _col, tokens

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Scores are rounded before they are compared or ranked: sums of doubles depend
# on their order, and a rank must not depend on how the data was partitioned.
SCORE_DIGITS = 9
# Vectors are stored as floats, which carry about seven digits.
VECTOR_DIGITS = 6

DEFAULT_DIM = 64
# Tokens that a task hashes at a time, but for those of one text.
HASH_TOKENS = 4_000_000


def _doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column | str) -> Column:
    squares = F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x)
    return F.sqrt(squares)


def l2_normalize(v: Column | str) -> Column:
    """Unit vector in double precision; a zero vector stays zero."""
    scale = F.coalesce(F.nullif(l2_norm(v), F.lit(0.0)), F.lit(1.0))
    # The norm is put into a one-element array so that it is worked out once per
    # row and not once per component.
    return F.flatten(
        F.transform(F.array(scale), lambda s: F.transform(_doubles(v), lambda x: x / s))
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of unit vectors, rounded to ``VECTOR_DIGITS``."""
    return F.round(dot(a, b), VECTOR_DIGITS)


def hash_embedding(text: Column | str, dim: int = DEFAULT_DIM) -> Column:
    """Feature-hashed, L2-normalised token counts (Weinberger et al., 2009).

    Each token adds one to the component its MD5 selects; counts are unsigned so
    that no text with a token can end up as the zero vector. A null text has null
    components. It is row-local, and a task hashes each distinct token of a batch once.
    It stands in for a language model.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch).fill_null(0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes, dtype=np.int64) // HASH_TOKENS
            edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            found = [_hashed(batch.slice(lo, hi - lo), dim) for lo, hi in zip(edges, edges[1:])]
            yield pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(tokens(text))


def _hashed(lists: pa.ListArray, dim: int) -> pa.ListArray:
    """Unit vectors of token counts."""
    n = len(lists)
    sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    # The first four hexadecimal digits of the MD5, as a number.
    digests = b"".join([hashlib.md5(token, usedforsecurity=False).digest()[:2] for token in distinct])
    slot = np.frombuffer(digests, ">u2").astype(np.int64) % dim
    cell = np.repeat(np.arange(n) * dim, sizes) + slot[coded.indices.to_numpy(zero_copy_only=False)]
    counts = np.bincount(cell, minlength=n * dim).reshape(n, dim).astype(float)
    norm = np.sqrt(np.square(counts).sum(1))
    norm[norm == 0] = 1.0
    unknown = np.repeat(lists.is_null().to_numpy(zero_copy_only=False), dim)
    values = pa.array((counts / norm[:, None]).astype(np.float32).ravel(), pa.float32(), mask=unknown)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), values)
