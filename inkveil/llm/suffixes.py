"""Suffix-array dedup: removes each byte that a window of bytes covers which also starts in a document of smaller doc_id.

In each bucket of units the distinct units are laid one after another and their suffixes sorted in two stages, as deep as a window: those not greater than their successors by first character are sorted
directly, eight bytes at a time; all others are induced from these by one scan over the buckets of first characters.
Adjacent suffixes' common prefixes then tell equal windows: those between which none is shorter than a window.

Nulls: a null or empty text has nothing to remove. A null doc_id counts as greater than all. Rows of one doc_id don't remove
from each other. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import NO_ID, rest_of
from .common import binary_array, gather, runs
from .repeats import Block, Shape, byte_grams, together, without_repeats

WINDOW, GRAM = 50, 16  # byte_grams has 16
SHAPE = Shape(WINDOW, GRAM, False, 16)
#: Anchors are told apart by the hash's leading bits, as the units are.
ANCHOR_BITS, NO_HASH = np.uint64(31), np.uint64(2**64 - 1)
#: Bytes that are sorted together.
SORTED_BYTES = 2 << 20


def packed(text: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts like them; zeros follow the text, at more places."""
    out = np.concatenate([text, np.zeros(more + 8, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        out = out[:-size] << np.uint64(8 * size) | out[size:]
    return out


def two_stage(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """The places of text in the order of their suffixes' first depth bytes."""
    n = len(text)
    words = packed(text, depth + 8) if words is None else words
    after = np.append(text[1:], 0)
    direct = np.flatnonzero(text <= after)
    direct = direct[np.argsort(words[direct], kind="stable")]
    group = np.cumsum(np.append(False, words[direct[1:]] != words[direct[:-1]])) if len(direct) else np.zeros(0, np.int64)
    for skip in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(tied):
            break
        key = words[direct[tied] + skip]
        order = np.lexsort((key, group[tied]))
        direct[tied], key = direct[tied][order], key[order]
        new = np.zeros(len(direct), bool)
        new[1:] = ~same
        new[tied[1:]] |= key[1:] != key[:-1]
        group = np.cumsum(new)
    # induce the others: a suffix greater than its successor stands in a later bucket than this
    total = np.bincount(text, minlength=256)
    start = np.cumsum(total) - total
    begin = np.bincount(text[direct], minlength=256)
    out = np.empty(n, np.int64)
    at = 0
    for c in np.flatnonzero(begin):
        out[start[c] + total[c] - begin[c] : start[c] + total[c]] = direct[at : at + begin[c]]
        at += begin[c]
    fill = start.copy()
    if n and text[-1] > 0:
        out[fill[text[-1]]] = n - 1
        fill[text[-1]] += 1
    for c in np.flatnonzero(total):
        before = out[start[c] : start[c] + total[c]] - 1
        before = before[before >= 0]
        letter = text[before]
        before, letter = before[letter > c], letter[letter > c]
        order = np.argsort(letter, kind="stable")
        before, each = before[order], np.bincount(letter, minlength=256)
        at = 0
        for d in np.flatnonzero(each):
            out[fill[d] : fill[d] + each[d]] = before[at : at + each[d]]
            fill[d] += each[d]
            at += each[d]
    return out


def common_prefixes(words: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The length of the common prefix of each two neighbours in order, depth (a multiple of 8 is compared) at most."""
    length = np.zeros(max(0, len(order) - 1), np.int64)
    open_ = np.arange(len(length))
    for skip in range(0, depth, 8):
        differ = words[order[open_] + skip] ^ words[order[open_ + 1] + skip]
        length[open_] = skip + sum((differ < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(8))
        open_ = open_[differ == 0]
        if not len(open_):
            break
    return np.minimum(length, depth)


def least_ids(text: np.ndarray, offsets: np.ndarray, windows: np.ndarray, least: np.ndarray, _: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window of each unit the least doc_id of the units that have it."""
    first = np.cumsum(windows) - windows
    value = np.repeat(least, windows)
    # units that share a window have its anchor in common: they are sorted together
    begin = offsets[:-1]
    grams = np.append(byte_grams(text) >> ANCHOR_BITS, NO_HASH)
    anchor = np.minimum.reduceat(grams, np.stack([begin, begin + window - GRAM + 1], 1).ravel())[::2]
    for part in together(anchor, np.diff(offsets), SORTED_BYTES):
        body, ends = gather(text, begin[part], offsets[part + 1] - begin[part])
        n = windows[part]
        own = np.repeat(np.arange(len(part)), n)
        within = np.arange(len(own)) - (np.cumsum(n) - n)[own]
        slot = np.full(len(body), -1)
        slot[ends[own] + within] = first[part][own] + within
        words = packed(body, window + 8)
        order = two_stage(body, window, words)
        order = order[slot[order] >= 0]
        new = np.append(True, common_prefixes(words, order, window) < window)
        low = np.minimum.reduceat(value[slot[order]], np.flatnonzero(new))
        value[slot[order]] = low[np.cumsum(new) - 1]
    return value


def _kept(block: Block, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes left, and their documents' offsets in them."""
    before = np.zeros(len(removed) + 1, np.int32)
    np.cumsum(~removed, out=before[1:])
    return block.body[~removed], before[block.offsets].astype(np.int64)


def _whole_characters(block: Block, removed: np.ndarray) -> np.ndarray:
    """removed, and with any byte of a character (a byte and the continuation bytes after it) the whole of it."""
    first, stop = runs(removed)
    inside = lambda at: (block.body[np.minimum(at, len(removed) - 1)] & 0xC0 == 0x80) & (at < len(removed))
    removed = removed.copy()
    for _ in range(3):  # a character has four bytes at most; texts begin with whole ones
        first, stop = first - inside(first), stop + inside(stop)
        removed[first], removed[stop - 1] = True, True
    return removed


def _cut(block: Block, removed: np.ndarray, _: dict) -> pa.RecordBatch:
    kept, ends = _kept(block, removed)
    size = np.diff(block.offsets)
    begins = removed & ~np.append(False, removed[:-1])
    begins[block.offsets[:-1][block.offsets[:-1] < block.offsets[-1]]] |= removed[block.offsets[:-1][block.offsets[:-1] < block.offsets[-1]]]
    spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[block.offsets])
    columns = [pa.array(block.ids, mask=block.ids == NO_ID), pa.array(size), pa.array(size - np.diff(ends)), pa.array(spans), binary_array(kept, ends).cast(pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of each row."""
    return without_repeats(docs, SHAPE, least_ids, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _texts(block: Block, removed: np.ndarray, row: dict) -> pa.RecordBatch:
    kept, ends = _kept(block, _whole_characters(block, removed))
    rest = rest_of(row)
    return rest.append_column("text", binary_array(kept, ends).cast(pa.binary()).cast(pa.string()))


def without_passages(docs: DataFrame) -> DataFrame:
    """docs without the bytes that remove_passages removes, and without the rest of characters of which it removes a part. A null text becomes empty."""
    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(*others).schema.add("text", "string")
    return without_repeats(docs, SHAPE, least_ids, _texts, schema, *others).select(docs.columns)


def _digest(block: Block, removed: np.ndarray, row: dict) -> pa.RecordBatch:
    cut = _cut(block, removed, row)
    return cut.set_column(4, "kept_sha256", pa.array([hashlib.sha256(k.as_buffer()).hexdigest() for k in cut.column("kept")], pa.string()))


def op8_suffixes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(docs, SHAPE, least_ids, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op8_suffixes": op8_suffixes}
SQL: dict[str, str] = {}
