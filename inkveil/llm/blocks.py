"""Documents gathered into blocks, which are written once, bucketed by block: what is found out about blocks comes back without moving the texts.

A block is a row: its number (random), the documents' ids, their texts one after another and the offsets into these, each compressed,
and the other columns that were asked for as an Arrow stream. Blocks end with their partition, so that a small table has small ones.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, dropped, flat, shared_folder, texts

BLOCK_BYTES = 6 << 20
#: Bytes of text in a bucket of the table of blocks; the number of buckets is Spark's limit at most.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 32 << 20, 24, 100_000
#: Stands for a null doc_id.
NO_ID = np.iinfo(np.int64).max
SCHEMA = "block long, ids binary, offsets binary, body binary, more binary"
_CODEC = pa.Codec("zstd", compression_level=7)


def pack(values: np.ndarray) -> bytes:
    """Compressed, the bytes of equal weight together."""
    if not len(values):
        return b""
    plain = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(plain).to_bytes(8, "little") + _CODEC.compress(plain, asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    plain = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(plain.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_ascending(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers in ascending order, by their distances."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def gathered(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most so many bytes of text, or of one row that is longer."""
    held, size = [], 0
    for batch in chunks(batches, most=most):
        own = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if held and size + own > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _rows(batches: Iterator[pa.RecordBatch], more: list[str], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches, most):
        body, offsets = flat(batch.column("text"))
        ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        rest = b""
        if more:
            out = pa.BufferOutputStream()
            table = batch.select(more)
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(table)
            rest = out.getvalue().to_pybytes()
        number = int.from_bytes(os.urandom(8), "little") >> 1
        yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([x], pa.binary()) for x in (pack(ids), pack(offsets), pack(body), rest))], ["block", "ids", "offsets", "body", "more"])


def text_bytes(docs: DataFrame) -> int:
    return docs.select(F.sum(F.octet_length("text"))).first()[0] or 0


#: Spark's setting by which a query's shuffle files go when it is done.
_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written in here is in the shared folder when it is done, and its shuffle files go at once. The session's setting is put back."""
    before = spark.conf.get(_REMOVED, "false")
    spark.conf.set(_REMOVED, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVED, before)


def bucketed(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """Rows with large compressed columns, written in the shared folder in buckets by block."""
    spark, own = rows.sparkSession, uuid.uuid4().hex
    path = f"{shared_folder(spark)}/{name}-{own}"
    with shuffles_removed(spark):
        rows.write.option("path", path).option("compression", "uncompressed").bucketBy(buckets, "block").format("parquet").saveAsTable(f"{name}_{own}")
    out = spark.table(f"{name}_{own}")
    out._inkveil_table, out._inkveil_path = f"{name}_{own}", path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Deletes tables of bucketed() and written(), and takes the former from the catalogue, once nothing that is still to be computed reads them."""
    for df in tables:
        if name := getattr(df, "_inkveil_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    dropped(*tables)


def in_blocks(docs: DataFrame, *more: str, most: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """The table of blocks, with the named columns beside, the bytes of all texts, and the number of the table's buckets."""
    spark, size = docs.sparkSession, text_bytes(docs)
    own = [c for c in more if c != "doc_id"]
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *own)
    texts(docs.select("doc_id", "text"))  # for its batches
    rows = source.mapInArrow(lambda batches: _rows(batches, list(more), most), SCHEMA)
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
    table = bucketed(rows, buckets, "blocks")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # rows are large from here on
    return table, size, buckets


def rest_of(row: dict) -> pa.RecordBatch:
    """The other columns of a block."""
    return pa.ipc.open_stream(row["more"]).read_next_batch()
