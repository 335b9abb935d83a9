"""Substring dedup by FM-index: removes each word that a window of words covers which also starts anywhere else.

Each bucket of units (the shard) has an FM-index of its distinct units: the Burrows-Wheeler transform of their words, in a
wavelet tree over prefix codes, whose bit vectors have counts for each 64 bits; frequent words have short codes, so that the
tree is compressed to about the words' entropy. The units are then streamed against it: backward search gives their
matching statistics, and each match as long as a window reports the interval that it covers.

Nulls: a null or empty text has no words; nothing is removed. doc_id is only passed on, null or repeated: copies of a row
repeat each other's windows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import NO_ID
from .common import binary_array, byte_hashes, codes_of, gather, prefix_sums, span_hashes
from .repeats import Block, Shape, together, without_repeats

WINDOW, GRAM = 35, 8
SHAPE = Shape(WINDOW, GRAM, True, 16)
#: Anchors are told apart by the hash's leading bits, as the units are.
ANCHOR_BITS = np.uint64(31)
#: Words in one index.
INDEX_WORDS = 250_000


class BitVector:
    """Bits with the number of ones before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])[:-1].astype(np.int32)
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletTree:
    """A wavelet tree over prefix codes: a symbol that makes up the share p of all has a code of -log2 p bits, rounded up, so that the tree takes about a symbol's entropy.

    Its levels are one bit vector each: level k has the bits k of all symbols whose code is longer than k, those with the same first k bits together.
    """

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        count = np.bincount(symbols, minlength=n_symbols)
        length = np.maximum(1, np.ceil(np.log2(len(symbols) / np.maximum(count, 1))).astype(np.int64))
        length[count == 0] = 0
        deepest = int(length.max(initial=1))
        # codes as numbers of so many bits, in order of length: each begins where the one before it ends
        order = np.argsort(np.where(count > 0, length, deepest + 1), kind="stable")
        room = np.where(count > 0, 1 << deepest - length, 0)[order]
        code = np.empty(n_symbols, np.int64)
        code[order] = np.cumsum(room) - room
        self.length, self.levels, self.bit, self.base = length, [], [], []
        own = code[symbols]
        for k in range(deepest):
            shift = deepest - k - 1
            bit = (own >> shift & 1).astype(np.uint8)
            vector = BitVector(bit)
            # of all symbols: their bit, and where those with their first k bits begin
            begin = np.searchsorted(own >> shift + 1, code >> shift + 1)
            self.levels.append(vector)
            self.bit.append((code >> shift & 1).astype(bool))
            self.base.append((begin, vector.ones(begin)))
            longer = length[symbols] > k + 1
            # stable by the first k + 1 bits; what is in order by k bits needs each group parted only
            group = begin[symbols]
            ones = np.cumsum(bit, dtype=np.int64) - bit
            before = ones - self.base[-1][1][symbols]
            zeros = np.add.reduceat(1 - bit.astype(np.int64), np.flatnonzero(np.append(True, group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
            which = np.cumsum(np.append(False, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
            place = group + np.where(bit, zeros[which] + before, np.arange(len(group)) - group - before)
            moved = np.empty(len(symbols), np.int64)
            moved[place] = np.where(longer, symbols, -1)
            symbols = moved[moved >= 0]
            own = code[symbols]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        at, length = at.copy(), self.length[symbol]
        live = np.arange(len(symbol))
        for k, vector in enumerate(self.levels):
            keep = length[live] > k
            if not keep.all():
                live = live[keep]
                if not len(live):
                    break
            mine, place = symbol[live], at[live]
            begin, before = self.base[k]
            ones = vector.ones(begin[mine] + place) - before[mine]
            at[live] = np.where(self.bit[k][mine], ones, place - ones)
        return at


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The places of symbols in the order of their suffixes' first depth symbols at least."""
    rank, size = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - size)] = rank[size:] + 1
        key = rank * (len(rank) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        rank = np.empty(len(order), np.int64)
        rank[order] = new
        size *= 2
        if size >= depth or new[-1] == len(order) - 1:
            return order


class FMIndex:
    """symbols: from 1 on, with a 0 after each unit; depth: of the longest search."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, depth: int):
        self.size = len(symbols)
        self.transform = WaveletTree(symbols[sorted_suffixes(symbols, depth) - 1], n_symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that are symbol and then one of low to high."""
        both = self.transform.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.below[symbol] + both[: len(symbol)], self.below[symbol] + both[len(symbol) :]


def repeated_windows(index: FMIndex, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of units at begin in symbols: units (by number) and the places from a to b where windows start that the index has twice or more.

    The matching statistic of a place, how far back from it the index goes on to have what stands there twice, is found by backward
    search. One of a window or more reports an interval, whatever its length; the search then goes on at the last place that a
    window over a symbol further back could end at, or, after a shorter match, one place back.
    """
    unit = np.flatnonzero(length >= window)
    end = length[unit] - 1
    matched, low, high = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64), np.full(len(unit), index.size)
    found = []
    while len(unit):
        down, up = index.back(symbols[begin[unit] + end - matched], low, high)
        on = up - down > 1
        matched += on
        over = ~on | (matched > end)
        if over.any():
            full = over & (matched >= window)
            first = end - matched + 1
            found.append((unit[full], first[full], end[full] - window + 2))
            end = np.where(over, np.where(full, first + window - 2, end - 1), end)
            end[over & (first == 0)] = 0  # nothing further back
            matched[over] = 0
        low, high = np.where(over, 0, down), np.where(over, index.size, up)
        live = end >= window - 1
        if not live.all():
            unit, end, matched, low, high = unit[live], end[live], matched[live], low[live], high[live]
    return tuple(np.concatenate([*(f[k] for f in found), np.zeros(0, np.int64)]) for k in range(3))


def repeated(text: np.ndarray, offsets: np.ndarray, windows: np.ndarray, _: np.ndarray, whole: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window of each unit: -1 if it is repeated, else NO_ID. A unit that is repeated as a whole is in the index twice."""
    ends = np.flatnonzero(text == 32) + 1
    starts = np.append(0, ends)[: len(ends)]
    begin = np.searchsorted(starts, offsets[:-1])
    first = np.cumsum(windows) - windows
    step = np.zeros(int(windows.sum()) + 1, np.int64)
    sums = prefix_sums(byte_hashes(text, starts, ends))
    grams = np.arange(max(0, len(starts) - gram + 1))
    hashes = np.append(span_hashes(sums, grams, grams + gram) >> ANCHOR_BITS, np.uint64(2**64 - 1))
    anchor = np.minimum.reduceat(hashes, np.stack([begin, begin + window - gram + 1], 1).ravel())[::2]
    length = windows + window - 1
    for part in together(anchor, length, INDEX_WORDS):
        asked = len(part)
        part = np.concatenate([part, part[whole[part]]])
        n = length[part]
        own = np.cumsum(n) - n
        word = np.repeat(begin[part] - own, n) + np.arange(int(n.sum()))
        body, stop = gather(text, starts[word], ends[word] - starts[word])
        codes, distinct = codes_of(binary_array(body, stop))
        symbols = np.zeros(len(codes) + len(part), np.int64)
        place = own + np.arange(len(part))  # a separator after each unit
        symbols[np.arange(len(codes)) + np.repeat(np.arange(len(part)), n)] = codes + 1
        index = FMIndex(symbols, len(distinct) + 1, int(n.max()) + 1)
        unit, a, b = repeated_windows(index, symbols, place[:asked], n[:asked], window)
        np.add.at(step, first[part[unit]] + a, 1)
        np.add.at(step, first[part[unit]] + b, -1)
    return np.where(np.cumsum(step[:-1]) > 0, -1, NO_ID)


def _cut(block: Block, removed: np.ndarray, _: dict) -> pa.RecordBatch:
    gone = np.repeat(removed, block.ends - block.starts)
    kept = [block.body[a:b][~gone[a:b]].tobytes()[:-1] for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
    count = np.concatenate([[0], np.cumsum(removed)])[block.first]
    columns = [pa.array(block.ids, mask=block.ids == NO_ID), pa.array(np.diff(block.first)), pa.array(np.diff(count)), pa.array(kept, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])


def remove_windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, one blank between) of each row."""
    return without_repeats(docs, SHAPE, repeated, _cut, "doc_id long, n_words long, n_removed long, kept binary")


def _digest(block: Block, removed: np.ndarray, row: dict) -> pa.RecordBatch:
    cut = _cut(block, removed, row)
    return cut.set_column(3, "kept_sha256", pa.array([hashlib.sha256(k.as_buffer()).hexdigest() for k in cut.column("kept")], pa.string()))


def op7_fmindex(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(docs, SHAPE, repeated, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


QUERIES = {"op7_fmindex": op7_fmindex}
SQL: dict[str, str] = {}
