"""Compression of vectors to short codes: a codebook for each part of the components, fitted on all vectors in whole numbers.

Vectors become integers floor(scale * x) and are stored once in columnar blocks: a block is an array with a row for each
component, so that distances to a codebook's entries add up component by component. Each round of fitting is a treeAggregate over
these blocks: a task adds its parts to tensors of integer sums and counts by entry (np.add.at), and the tensors, whose
size is that of the codebooks, merge through a tree of reducers. Sums of integers don't depend on the order in which tasks end, so that
codes are the same on every cluster, and after an executor is lost.

Vectors that are null, hold null or non-finite components, are empty, or have another length than most others take no part.
Part sizes differ by one at most where the length isn't a multiple of the number of parts (larger ones first). Rows
of null vec_id come last among those that the codebooks start from, equal vec_ids in order of their vectors; repeated rows each
count. Fewer rows than entries: codebooks have an entry for each row. Integers are exact at any size up to a long; an error
beyond a long is its largest value. Null labels are one label. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .vectors import BLOCK_VALUES, MOST_LONG, floors, largest, packed, taking_part, unpacked

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Levels of the tree through which sums merge.
DEPTH = 3
#: Totals of so many labels at most are sent to all tasks; more are joined by a shuffle.
SENT_LABELS = 100_000


def bounds_of(length: int, parts: int) -> list[tuple[int, int]]:
    """First and last (excluded) component of each part."""
    ends = np.cumsum([len(x) for x in np.array_split(np.arange(length), parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, length: int) -> Iterator[pa.RecordBatch]:
    """Rows of many vectors: their ids and labels as an Arrow stream, their integers by component, and how large these are."""
    rows = max(1, BLOCK_VALUES // length)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            out = pa.BufferOutputStream()
            names = part.select(["vec_id", "label"])
            with pa.ipc.new_stream(out, names.schema) as writer:
                writer.write_batch(names)
            columns = floors(part.column("vector"), scale).T
            yield pa.RecordBatch.from_arrays(
                [pa.array([out.getvalue().to_pybytes()], pa.binary()), pa.array([packed(columns)], pa.binary()), pa.array([part.num_rows], pa.int64()), pa.array([float(largest(columns))])],
                ["names", "columns", "n", "most"],
            )


def distances(columns: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of a block's part (a row for each component) to the entries of its codebook, component by component."""
    room = len(columns) * (largest(columns) + largest(book)) ** 2
    kind = np.int32 if room < 1 << 31 else np.int64 if room < 1 << 63 else object
    total = np.zeros((columns.shape[1], len(book)), kind)
    for values, entries in zip(columns, book.T, strict=True):
        apart = values.astype(kind)[:, None] - entries.astype(kind)[None, :]
        total += apart * apart
    return total


def _added(sums: tuple[np.ndarray, np.ndarray], columns: np.ndarray, book: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The tensors of sums (entries x components) and counts (parts x entries) with a block's parts added to their nearest entries."""
    totals, counts = sums
    for p, (a, b) in enumerate(bounds):
        nearest = distances(columns[a:b], book[:, a:b]).argmin(1)
        np.add.at(totals[:, a:b], nearest, columns[a:b].T.astype(totals.dtype))
        np.add.at(counts[p], nearest, 1)
    return totals, counts


def _fitted(blocks: DataFrame, book: np.ndarray, bounds: list[tuple[int, int]], rounds: int) -> np.ndarray:
    """The codebooks (entries x components) after the rounds."""
    size = blocks.agg(F.sum("n").alias("n"), F.max("most").alias("most")).first()
    kind = np.int64 if size["n"] * (size["most"] + 1) < 2**62 else object
    arrays = blocks.select("columns").rdd.map(lambda row: unpacked(row[0]))
    for _ in range(rounds):
        sent = blocks.sparkSession.sparkContext.broadcast(book)
        zero = np.zeros(book.shape, kind), np.zeros((len(bounds), len(book)), np.int64)
        totals, counts = arrays.treeAggregate(zero, lambda sums, columns: _added(sums, columns, sent.value, bounds), lambda x, y: (x[0] + y[0], x[1] + y[1]), DEPTH)  # noqa: B023
        book = book.copy()
        for p, (a, b) in enumerate(bounds):
            used = counts[p] > 0
            book[used, a:b] = totals[used, a:b] // counts[p][used, None]
        sent.unpersist()
    return book


def _coded(batches: Iterator[pa.RecordBatch], book: np.ndarray, bounds: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for names, columns in zip(batch.column("names"), batch.column("columns"), strict=True):
            rows, block = pa.ipc.open_stream(names.as_py()).read_next_batch(), unpacked(columns.as_py())
            codes, errors = np.empty((block.shape[1], len(bounds)), np.uint8), []
            for p, (a, b) in enumerate(bounds):
                apart = distances(block[a:b], book[:, a:b])
                codes[:, p] = apart.argmin(1)
                errors.append(apart[np.arange(len(apart)), codes[:, p]])
            if any(e.dtype == object or largest(e) >= 1 << 58 for e in errors):
                error = [min(sum(map(int, x)), MOST_LONG) for x in zip(*errors, strict=True)]
            else:
                error = sum(e.astype(np.int64) for e in errors)
            text = codes.tobytes().hex()
            width = 2 * len(bounds)
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array([text[i : i + width] for i in range(0, len(text), width)], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])


def digest(book: np.ndarray, bounds: list[tuple[int, int]]) -> str:
    """SHA-256 of all integers of the codebooks in decimal, by part, entry and place in the part."""
    return hashlib.sha256(",".join(str(int(x)) for a, b in bounds for entry in book[:, a:b] for x in entry).encode()).hexdigest()


def compress(table: DataFrame, vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code and error of each vector that takes part, written to a table; the codebooks, entries x components).

    A code has two hexadecimal digits for each part: the entries' numbers, 256 entries at most.
    """
    if not 1 <= entries <= 256 or scale & (scale - 1):
        raise ValueError("entries: 1 to 256; scale: a power of two")
    good, length = taking_part(table.select("vec_id", F.col(label).alias("label"), F.col(vector).alias("vector")), "vector")
    kinds = {f.name: f.dataType.simpleString() for f in good.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    if not length:
        return table.sparkSession.createDataFrame([], schema), np.zeros((0, 0), np.int64)
    bounds = bounds_of(length, parts)
    first = good.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").toArrow()
    book = floors(first["vector"].combine_chunks(), scale)
    blocks = written(good.mapInArrow(lambda batches: _blocks(batches, scale, length), "names binary, columns binary, n long, most double"), "vector-blocks")
    book = _fitted(blocks, book, bounds, rounds)
    coded = written(blocks.mapInArrow(lambda batches: _coded(batches, book, bounds), schema), "vector-codes")
    dropped(blocks)
    return coded, book


def compressed(table: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (the errors' sum over equal labels) and codebooks_sha256 of each vector that takes part."""
    coded, book = compress(table, **options)
    bounds = bounds_of(book.shape[1], options.get("parts", PARTS)) if book.size else []
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = coded.groupBy("label").agg(F.least(whole, F.lit(MOST_LONG)).cast("long").alias("label_error")).withColumnRenamed("label", "__label")
    few = totals.count() <= SENT_LABELS
    joined = coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(book, bounds)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_vector_codes": op11_vector_codes}


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of the same rows, for vectors of one length that is a multiple of parts."""
    steps = [
        "good AS (SELECT row_number() OVER () AS r, vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cells AS (SELECT r, vec_id, label, CAST(floor({scale} * CAST(unnest(v) AS DOUBLE)) AS BIGINT) AS x, generate_subscripts(v, 1) - 1 AS d, len(v) // {parts} AS w FROM good)",
        "pieces AS (SELECT r, d // w AS p, list(x ORDER BY d) AS x FROM cells GROUP BY r, d // w)",
        f"firsts AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS k FROM good QUALIFY k < {entries})",
        "book0 AS (SELECT p, k, x FROM pieces JOIN firsts USING (r))",
    ]
    for n in range(rounds + 1):
        apart = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"near{n} AS (SELECT r, p, x, k, e FROM (SELECT a.r, a.p, a.x, b.k, CAST({apart} AS BIGINT) AS e FROM pieces a JOIN book{n} b ON a.p = b.p) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY e, k) = 1)")
        if n < rounds:
            steps.append(f"flat{n} AS (SELECT p, k, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM near{n})")
            steps.append(f"means{n} AS (SELECT p, k, list(m ORDER BY i) AS x FROM (SELECT p, k, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM flat{n} GROUP BY p, k, i) GROUP BY p, k)")
            steps.append(f"book{n + 1} AS (SELECT p, k, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN means{n} m USING (p, k))")
    steps += [
        f"coded AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(e) AS BIGINT) AS error FROM near{rounds} GROUP BY r)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS s FROM book{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM good JOIN coded USING (r) CROSS JOIN digest"


SQL = {"op11_vector_codes": _sql()}
