"""Spans of crowded texts, whose matches are placed and chosen a batch of texts at a time, by columns; the same results as text.spans_of and text.accepted, which suit texts of few matches."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import found

#: As text.SPAN.
_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("raw", T.StringType())]))
#: Rounds in which all clusters of a batch choose at once, before what is left of long ones is chosen one by one.
ROUNDS = 8


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and values of a column of lists; a null is an empty list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), column.flatten()


def _placed(pieces: pa.ListArray) -> pa.ListArray:
    """For each row the spans of its searches' pieces (gap, match, gap, ..., match, gap), search by search."""
    rows, searches = _lists(pieces)
    bounds, texts = _lists(searches)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    size = np.diff(bounds)
    own = np.arange(len(texts)) - np.repeat(bounds[:-1], size)
    start = np.repeat(np.concatenate([[0], ends])[bounds[:-1]], size)
    at = np.flatnonzero(own % 2)
    e = ends[at] - start[at]
    counts = np.concatenate([[0], np.cumsum(own % 2)])[bounds[rows]]
    spans = pa.StructArray.from_arrays([pa.array(e - lengths[at], pa.int32()), pa.array(e, pa.int32()), texts.take(pa.array(at))], ["s", "e", "raw"])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)


def chosen(row: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which of the spans, in order by row, overlap none of their row's that is chosen before.

    Clusters, stretches that spans cover without a gap, choose side by side: the first in order stays, what it overlaps goes, the others are clustered anew.
    """
    kept = np.zeros(len(s), bool)
    width = int(e.max(initial=0)) + 1
    s, e = s + row * width, e + row * width
    left = np.lexsort((e, s))
    for _ in range(ROUNDS):
        if not len(left):
            return kept
        covered = np.maximum.accumulate(e[left])
        begins = np.concatenate([[True], s[left][1:] >= covered[:-1]])
        cluster = np.cumsum(begins) - 1
        first = np.minimum.reduceat(left, np.flatnonzero(begins))
        kept[first] = True
        apart = (s[left] >= e[first][cluster]) | (e[left] <= s[first][cluster])
        left = left[apart]
    taken: list[int] = []  # what long clusters have left, in order; starts and ends of disjoint spans, flat
    for i in np.sort(left).tolist():
        a, b = int(s[i]), int(e[i])
        at = bisect_left(taken, b)  # bounds before b: even, and the last not beyond a, where a to b is free
        if at % 2 == 0 and (at == 0 or taken[at - 1] <= a):
            taken[at:at] = [a, b]
            kept[i] = True
    return kept


def _accepted(candidates: pa.ListArray) -> pa.ListArray:
    rows, spans = _lists(candidates)
    s, e = (spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    kept = chosen(np.repeat(np.arange(len(rows) - 1), np.diff(rows)), s, e)
    counts = np.concatenate([[0], np.cumsum(kept)])[rows]
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans.filter(pa.array(kept)))


def accepted(df: DataFrame, text: Column, searches: list[tuple[str, str | tuple[str, ...] | None]], into: str) -> DataFrame:
    """df with the column into, array<span>: of all matches of each pattern (none empty, see text.found) and gate, pattern by pattern, those that overlap none accepted before."""
    pieces = F.array(*(F.coalesce(found(text, pattern, gate), F.expr("cast(array() as array<string>)")) for pattern, gate in searches))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            *columns, last = batch.columns
            yield pa.RecordBatch.from_arrays([*columns, _accepted(_placed(last))], [*batch.schema.names[:-1], into])

    schema = T.StructType([*df.schema.fields, T.StructField(into, _SPANS)])
    return df.withColumn("__searched", pieces).mapInArrow(batches, schema)
