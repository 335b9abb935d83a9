"""What the training-data operators share: Arrow text as flat bytes, hashes of its parts, and (from elsewhere) tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.tables import dropped, shared_folder, written  # noqa: F401  for the operators

#: Bytes of text that an Arrow function works on at once; a longer text comes alone.
CHUNK_BYTES = 2 << 20
STRETCH = 1 << 19
#: `[\x20\x09-\x0D]`, the separators of words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns, and none of the table's others; small Arrow batches, as texts can be long."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


#: What a worker keeps from one task for the next: called, these forget it.
FORGET: list[Callable[[], None]] = []


def with_room(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, after the worker has given back what earlier tasks left to it: tasks that take whole blocks have room then."""
    for forget in FORGET:
        forget()
    _give_back()
    return batches


def left_clean(out: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task gives; when it is done, its memory is given back, as its worker may wait long for another one."""
    yield from out
    _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only of the GNU library
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, none empty, cut so that the column holds at most so many bytes; a single longer value comes alone."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column as one array, and the len + 1 offsets into it; nulls are empty."""
    kind = pa.large_binary()
    column = (column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "") if column.null_count else column).cast(kind)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def binary_array(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The slices of body between neighbouring offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(body))])


def joined_slices(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes body[starts[i]:ends[i]] one after another (the slices are in order and disjoint), and their offsets."""
    step = np.zeros(len(body) + 1, np.int8)
    step[starts] += 1
    np.add.at(step, ends, -1) if len(ends) and (np.diff(ends) == 0).any() else step.__setitem__(ends, step[ends] - 1)
    keep = np.cumsum(step[:-1], dtype=np.int8) > 0
    return body[keep], np.concatenate([[0], np.cumsum(ends - starts)])


def gather(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of body, which may overlap, one after another, and their offsets; indices for a stretch of bytes at a time."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out, at = np.empty(int(offsets[-1]), body.dtype), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, "right")) - 1)
        base = offsets[at]
        out[base : offsets[stop]] = body[np.repeat(starts[at:stop] - offsets[at:stop] + base, sizes[at:stop]) + np.arange(offsets[stop] - base)]
        at = stop
    return out, offsets


def word_bounds(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of each text, and the number of words before each text (len + 1)."""
    inside = ~SPACE[body]
    first = np.zeros(len(body), bool)
    starts_of = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts_of] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    last = np.zeros(len(body), bool)
    last[starts_of[1:] - 1] = True
    if len(body):
        last[-1] = True
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | last[:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def codes_of(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes into the distinct values, and these."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BYTES = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2 ** 64, n at least."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """For span_hashes: sums of value i times base ** i, from none to all values."""
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the values from starts to ends, the same wherever these stand and on every machine; equal values have equal hashes."""
    _, down = _powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of slices of bytes, whose starts are in order; a stretch of body at a time, as the sums are eight times as large."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        stop = int(np.searchsorted(starts, base + STRETCH, "left"))
        sums = prefix_sums(_BYTES[body[base : ends[at:stop].max()]])
        out[at:stop] = span_hashes(sums, starts[at:stop] - base, ends[at:stop] - base)
        at = stop
    return out


def repeats(hashes: np.ndarray) -> np.ndarray:
    """Which values stand twice or more."""
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    return twice[at] == hashes


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit values: every input bit moves every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class TokenPool:
    """The ids of numbered pieces, for gathering many pieces' ids at once; forgets all beyond a number of pieces."""

    def __init__(self, most: int):
        self.most, self.known = most, {}
        self._ids, self._ends, self._fresh = np.zeros(0, np.int32), np.zeros(1, np.int64), []

    def add(self, piece, ids: list[int], keep: bool = True) -> int:
        number = len(self._ends) - 1 + len(self._fresh)
        self._fresh.append(ids)
        if keep:
            self.known[piece] = number
        return number

    def trim(self) -> None:
        """Between batches."""
        if len(self._ends) > self.most:
            self.__init__(self.most)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces one after another, and the number of ids before each piece (len + 1)."""
        if self._fresh:
            sizes = np.fromiter(map(len, self._fresh), np.int64, len(self._fresh))
            flat_ids = np.fromiter((i for ids in self._fresh for i in ids), np.int32, int(sizes.sum()))
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(sizes)])
            self._ids, self._fresh = np.concatenate([self._ids, flat_ids]), []
        n = self._ends[numbers + 1] - self._ends[numbers]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self._ids[np.repeat(self._ends[numbers] - ends[:-1], n) + np.arange(ends[-1])], ends
