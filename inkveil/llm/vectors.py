"""What operators on tables of vectors share: which rows take part, and their components as whole numbers."""

from __future__ import annotations

import math
import pickle
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A batch's vectors are worked on in blocks of about so many components.
BLOCK_VALUES = 1 << 18
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def taking_part(table: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows with finite vectors of the length that most of these have (of lengths as frequent, the larger one), and that length; 0 if there is none."""
    good = table.where(finite(F.col(vector)) & (F.size(vector) > 0))
    usual = good.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = usual["n"] if usual else 0
    return good.where(F.size(vector) == n), n


def floors(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, a row for each vector; scale is a power of two, so that no product is rounded.

    Numbers beyond 2 ** 52 come as Python's integers (in an array of objects), and beyond a long as its least or largest value.
    """
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if not values.size or np.abs(values).max() < 2**52 / scale:
        return np.floor(values * scale).astype(np.int64)
    exact = np.empty(values.size, object)
    exact[:] = [min(max(math.floor(Fraction(x) * scale), LEAST_LONG), MOST_LONG) for x in values.ravel().tolist()]
    return exact.reshape(values.shape)


def largest(values: np.ndarray) -> int:
    """The largest magnitude."""
    return int(np.abs(values).max()) if values.size else 0


def packed(values: np.ndarray) -> bytes:
    """An array as bytes, in the narrowest type that holds it."""
    if values.dtype == np.int64:
        most = largest(values)
        values = values.astype(next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max))
    return pickle.dumps(np.ascontiguousarray(values), protocol=5)


def unpacked(data: bytes) -> np.ndarray:
    return pickle.loads(data)
