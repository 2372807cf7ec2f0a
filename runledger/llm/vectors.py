"""Embeddings as numeric rows: which vectors take part, and how tasks read them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, vector as array<double>) of the rows whose vector has finite entries only, and the number of entries.

    Null and empty vectors, and those that hold null or non-finite entries, are left out. If lengths differ, the commonest counts
    (of several the largest) and other lengths are left out.
    """
    rows = vectors.select(F.col(id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (rows.where(F.size("vector") == sizes["d"]), sizes["d"]) if sizes else (rows, 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of an Arrow list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def lists(values: np.ndarray, type: pa.DataType) -> pa.Array:
    """The rows of a matrix as an Arrow list column."""
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), type))
