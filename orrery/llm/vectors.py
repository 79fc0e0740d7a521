"""Reading vector tables: what counts as a vector, and blocks of them in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and embedding (as it is) of the rows that take part.

    Rows with a null id, a null, empty or zero vector, or one with null or non-finite components take no part.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = own(embeddings, "vec_id", "embedding").where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where(F.exists("embedding", lambda x: x.isNotNull() & (x != 0)) & F.forall("embedding", finite))


def by_length(vectors: DataFrame) -> list[tuple[int, DataFrame]]:
    """Each length with its vectors: those of different lengths can't be compared. Few lengths are assumed."""
    lengths = sorted(r[0] for r in vectors.select(F.size("embedding")).distinct().collect())
    return [(n, vectors.where(F.size("embedding") == n)) for n in lengths]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column without nulls, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
