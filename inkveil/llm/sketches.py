"""Arrays of fixed size that all documents add to: each task sums its own, slices of them are summed by key, and the driver gets one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 64


def summed(df: DataFrame, adds: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """How often each value under 2 ** bits comes in what adds gives for the batches of df: 8 bytes for each value, for any input.

    At 2 ** 20 values a task sends 8 MB at most before compression.
    """
    size = (1 << bits) // SLICES

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            total += np.bincount(adds(batch), minlength=1 << bits)
        used = [k for k in range(SLICES) if total[k * size : (k + 1) * size].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([pa.compress(total[k * size : (k + 1) * size].astype("<i8").tobytes(), "zstd", asbytes=True) for k in used], pa.binary())], ["slice", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, sums in zip(batch.column("slice").to_pylist(), batch.column("sums"), strict=True):
                part = np.frombuffer(pa.decompress(sums.as_py(), 8 * size, "zstd"), "<i8")
                totals[k] = totals[k] + part if k in totals else part
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["slice", "sums"])

    parts = df.mapInArrow(partial, "slice int, sums binary").repartition(SLICES, "slice").mapInArrow(merge, "slice int, sums binary")
    out = np.zeros(1 << bits, np.int64)
    for row in parts.toArrow().to_pylist():
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["sums"], "<i8")
    return out
