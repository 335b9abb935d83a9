"""Packing of documents into windows by best-fit decreasing.

Documents are cut into pieces: full windows first, then the rest. Rests are dealt to groups of about GROUP pieces by a
hash, and in each group the longest piece comes first and goes to the open window with the least room that still holds
it. A segment tree over the amounts of room (each leaf: how many open windows have that room) finds that amount. Groups
are independent, so that packing is spread over the cluster; each leaves its last windows open, so that its size
decides how little is padded. Only the pieces' places and lengths are moved, not their ids.

Nulls: a null text is empty: one piece, of the end id alone. A null doc_id is passed on; rows that repeat are documents of
their own. Other columns of the input are not read. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbpe
from .common import binary_array, chunks, flat, texts, written

WINDOW, END_ID, GROUP = 2048, 1, 20_000


def _cut(batches: Iterator[pa.RecordBatch], window: int, end: int, name: str) -> Iterator[pa.RecordBatch]:
    bpe = wordbpe.coder(name)
    for batch in chunks(batches):
        ids, starts = wordbpe.with_end(*bpe.encode(*flat(batch.column("text"))), end)
        sizes = np.diff(starts)
        n = -(-sizes // window)
        doc = np.repeat(np.arange(len(sizes)), n)
        start = window * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
        length = np.minimum(window, sizes[doc] - start)
        body = ids.astype("<u4").view(np.uint8)
        at = 4 * np.append(starts[doc] + start, starts[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sizes[doc]), binary_array(body, at).cast(pa.binary())],
            ["doc_id", "start", "length", "doc_tokens", "ids"],
        )


def pieces(docs: DataFrame, window: int = WINDOW, end: int = END_ID, name: str = wordbpe.VOCABULARY) -> DataFrame:
    """doc_id, start, length, doc_tokens and ids (binary, 32-bit little-endian) of each piece; a document's ids end with one more, end."""
    return texts(docs).mapInArrow(lambda batches: _cut(batches, window, end, name), "doc_id long, start long, length long, doc_tokens long, ids binary")


class RoomTree:
    """How many open windows have each amount of room, as a segment tree; finds the least amount that is enough."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def at_least(self, room: int) -> int | None:
        count, at = self.count, room + self.leaves
        if count[at]:
            return room
        while at > 1:  # up to the first right neighbour with an open window, then down to its least
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For pieces, longest first: each one's window (from 0) and its place there."""
    tree, opened = RoomTree(window), [[] for _ in range(window + 1)]
    windows, places, n = [], [], 0
    for length in lengths:
        room = tree.at_least(length)
        if room is None:
            mine, room = n, window
            n += 1
        else:
            mine = opened[room].pop()
            tree.add(room, -1)
        windows.append(mine)
        places.append(window - room)
        if room > length:
            opened[room - length].append(mine)
            tree.add(room - length, 1)
    return windows, places


def pack(cut: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The pieces (those columns of them that cut has besides ids) with sequence_id and offset.

    A group's sequence ids begin at a multiple of 2 ** 32; within a group the order is by length, doc_id and start.
    """
    rows = cut.drop("ids") if "ids" in cut.columns else cut
    short = rows.where(F.col("length") < window)
    n = max(1, -(-short.count() // group))
    salt = F.pmod(F.xxhash64("doc_id", "start", "doc_tokens"), F.lit(n)).cast("int")
    schema = rows.schema.add("sequence_id", "long").add("offset", "long")

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop(columns="__group").sort_values(["length", "doc_id", "start", *sorted(set(frame.columns) - {"length", "doc_id", "start", "__group"})], ascending=[False, *[True] * (len(frame.columns) - 2)], kind="stable")
        windows, places = best_fit(frame["length"].tolist(), window)
        return frame.assign(sequence_id=np.array(windows, np.int64) + (int(key[0]) << 32), offset=np.array(places, np.int64))

    filled = short.withColumn("__group", salt).groupBy("__group").applyInPandas(fill, schema)
    # a full window is a sequence; its id comes from the row's place in the cut table, which is written once and then read
    full = rows.where(F.col("length") == window).withColumns({"sequence_id": F.monotonically_increasing_id() + (1 << 62), "offset": F.lit(0).cast("long")})
    return filled.unionByName(full)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return packed_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed_digests(docs: DataFrame) -> DataFrame:
    """Pieces with their sequences, and the checksum of each one's ids."""
    cut = written(pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op3_packing": op3_packing}
SQL: dict[str, str] = {}
