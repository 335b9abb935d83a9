"""Whitening of embeddings by a covariance that is counted in tiles.

Components become whole numbers x = floor(scale * c) + shift; their sums S are exact. Vectors are written once as column blocks: some
thousand rows of a tile of neighbouring dimensions. The blocks are shuffled by row-block, so that the tiles of the same rows meet in
a task; each pair of tiles (the key of its pairs of dimensions) is centred and multiplied, products add up by pair of tiles
in the task and then over all tasks, and the tiles make up the covariance V: what the driver gets and decomposes has the size of V, for any number of rows.

Centring is exact: with m = floor(S / n), x - m is a whole number, from which the remainder (S - n m) / n, below 1, is taken.
Components are unit eigenvectors of V by falling eigenvalue, with a positive entry of largest magnitude. Their number is that of
the dimensions at most. A component whose eigenvalue is zero to double precision (as of fewer vectors than components, or of constant
dimensions) has no whitened values: these are null, its explained share is 0, and identity_error leaves it out.

Vectors that are null, hold null or non-finite components, are empty, or have another length than most others take no part.
A null or repeated vec_id is passed on; repeated rows each count. Deviations are exact; one beyond a long is its largest value.
Other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .vectors import BLOCK_VALUES, MOST_LONG, floors, largest, packed, taking_part, unpacked

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Dimensions of a tile; a covariance has (length / TILE) ** 2 / 2 of them.
TILE = 32
#: Tasks that add up what the others have summed, before the driver does.
MERGERS = 16


@dataclass(frozen=True)
class Whitener:
    """What was fitted: the number of vectors, the sums of floor(scale * c), unit eigenvectors as columns, eigenvalues, and V's trace."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, whole: np.ndarray, first: int = 0) -> np.ndarray:
        """Doubles x - S / n of whole numbers (a row for each vector, dimensions from first on)."""
        return centred(whole, self.sums[first : first + whole.shape[1]], self.n)

    @property
    def sound(self) -> np.ndarray:
        """Which components have a variance at all."""
        return self.values > self.trace * len(self.sums) * np.finfo(float).eps

    def whitened(self, whole: np.ndarray) -> np.ndarray:
        """Projections over the standard deviations; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.sound, self.centred(whole) @ self.axes / np.sqrt(self.values), np.nan)

    def deviations(self, whole: np.ndarray) -> list[int] | np.ndarray:
        """Sums over the dimensions of (n x - S) ** 2, which the shift doesn't change."""
        if 2 * self.n * largest(whole) < 2 ** int(31 - np.log2(whole.shape[1]) / 2):
            apart = self.n * whole.astype(np.int64) - np.array(self.sums, np.int64)
            return (apart * apart).sum(1)
        return [min(sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums, strict=True)), MOST_LONG) for row in whole.tolist()]


def centred(whole: np.ndarray, sums: tuple[int, ...], n: int) -> np.ndarray:
    """Doubles x - S / n, rounded once."""
    parts = [divmod(s, n) for s in sums]
    floor, rest = np.array([m for m, _ in parts], whole.dtype if whole.dtype == object else np.int64), np.array([r / n for _, r in parts])
    return (whole.astype(floor.dtype) - floor).astype(np.float64) - rest


def _column_blocks(batches: Iterator[pa.RecordBatch], scale: int, length: int, tile: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BLOCK_VALUES // length)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            whole = floors(batch.column("vector").slice(at, rows), scale)
            firsts = list(range(0, length, tile))
            number = int.from_bytes(os.urandom(8), "little") >> 1
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(firsts)), pa.array(firsts, pa.int32()), pa.array([packed(whole[:, a : a + tile]) for a in firsts], pa.binary())], ["block", "first", "data"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each dimension, how many numbers a task has and their sum."""
    counts: dict[int, int] = {}
    sums: dict[int, int] = {}
    for batch in batches:
        for first, data in zip(batch.column("first").to_pylist(), batch.column("data"), strict=True):
            whole = unpacked(data.as_py())
            whole = whole if whole.dtype == object else whole.astype(np.int64)
            for d, total in enumerate(whole.sum(0).tolist(), first):
                counts[d], sums[d] = counts.get(d, 0) + len(whole), sums.get(d, 0) + total
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.array([Decimal(s) for s in sums.values()], pa.decimal128(38, 0))], ["dim", "n", "total"])


def _tile_rows(tiles: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(tiles)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([tiles[k].dumps() for k in keys], pa.binary())], ["i", "j", "sums"])


TILES = "i int, j int, sums binary"


def _multiplied(batches: Iterator[pa.RecordBatch], sums: tuple[int, ...], n: int) -> Iterator[pa.RecordBatch]:
    """From column blocks in order of row-block: for each pair of tiles, the sum of the centred blocks' products."""
    tiles: dict[tuple[int, int], np.ndarray] = {}
    block, held = None, {}

    def add() -> None:
        for i, left in held.items():
            for j, right in held.items():
                if i <= j:
                    product = left.T @ right
                    tiles[i, j] = tiles[i, j] + product if (i, j) in tiles else product

    for batch in batches:
        for number, first, data in zip(batch.column("block").to_pylist(), batch.column("first").to_pylist(), batch.column("data"), strict=True):
            if number != block:
                add()
                block, held = number, {}
            whole = unpacked(data.as_py())
            held[first] = centred(whole, sums[first : first + whole.shape[1]], n)
    add()
    yield _tile_rows(tiles)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tiles: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, j, data in zip(batch.column("i").to_pylist(), batch.column("j").to_pylist(), batch.column("sums"), strict=True):
            part = unpacked(data.as_py())
            tiles[i, j] = tiles[i, j] + part if (i, j) in tiles else part
    yield _tile_rows(tiles)


def _assembled(parts: DataFrame, size: int) -> np.ndarray:
    """The symmetric matrix of all tiles' sums, which are added up tile by tile; the driver gets each tile once."""
    out = np.zeros((size, size))
    for row in parts.repartition(MERGERS, "i", "j").mapInArrow(_merged, TILES).collect():
        i, j, tile = row["i"], row["j"], unpacked(bytes(row["sums"]))
        out[i : i + tile.shape[0], j : j + tile.shape[1]] += tile
    upper = np.triu(out)
    return upper + np.triu(out, 1).T


def fit(good: DataFrame, length: int, components: int = COMPONENTS, scale: int = SCALE, tile: int = TILE) -> Whitener:
    """The whitener of vectors (a column vector, all of one length)."""
    blocks = written(good.select("vector").mapInArrow(lambda batches: _column_blocks(batches, scale, length, tile), "block long, first int, data binary"), "column-blocks")
    totals = blocks.mapInArrow(_totals, "dim int, n long, total decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a row for each dimension
    n, sums = totals[0]["n"], tuple(int(row["total"]) for row in sorted(totals, key=lambda row: row["dim"]))
    met = blocks.repartition("block").sortWithinPartitions("block", "first")
    covariance = _assembled(met.mapInArrow(lambda batches: _multiplied(batches, sums, n), TILES), length) / n
    dropped(blocks)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Whitener(n, sums, axes, np.maximum(values, 0), float(np.trace(covariance)))


def _spread(batches: Iterator[pa.RecordBatch], whitener: Whitener, scale: int) -> Iterator[pa.RecordBatch]:
    """A task's sums of whitened values, and of their products, as one matrix with the sums below."""
    kept = whitener.sound
    total = np.zeros((kept.sum() + 1, kept.sum()))
    for batch in batches:
        values = whitener.whitened(floors(batch.column("vector"), scale))[:, kept]
        total += np.vstack([values.T @ values, values.sum(0)])
    yield _tile_rows({(0, 0): total})


def identity_error(good: DataFrame, whitener: Whitener, scale: int = SCALE) -> float:
    """The largest absolute entry of the whitened values' covariance minus the identity; 0.0 if no component has variance."""
    total = np.zeros((whitener.sound.sum() + 1, whitener.sound.sum()))
    for row in good.select("vector").mapInArrow(lambda batches: _spread(batches, whitener, scale), TILES).repartition(MERGERS).mapInArrow(_merged, TILES).collect():  # a row for each merger
        total += unpacked(bytes(row["sums"]))
    means = total[-1] / whitener.n
    return float(np.abs(total[:-1] / whitener.n - np.outer(means, means) - np.eye(len(means))).max(initial=0))


def _rows(batches: Iterator[pa.RecordBatch], whitener: Whitener, scale: int) -> Iterator[pa.RecordBatch]:
    k = len(whitener.values)
    explained = np.where(whitener.sound, whitener.values / (whitener.trace or 1), 0)
    step = max(1, BLOCK_VALUES // max(k, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            whole = floors(part.column("vector"), scale)
            ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(part.num_rows), k)))
            deviations = np.repeat(np.array(whitener.deviations(whole), np.int64), k)
            values = whitener.whitened(whole).ravel()
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(deviations), pa.array(values, mask=np.isnan(values)), pa.array(np.tile(explained, part.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "deviation", "whitened", "explained"])


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, tile: int = TILE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector that takes part and component."""
    good, length = taking_part(table.select("vec_id", F.col(vector).alias("vector")), "vector")
    schema = f"vec_id {good.schema['vec_id'].dataType.simpleString()}, component int, deviation long, whitened double, explained double"
    if not length:
        return table.sparkSession.createDataFrame([], schema).select("vec_id", "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(0.0).alias("identity_error"))
    whitener = fit(good, length, components, scale, tile)
    error = identity_error(good, whitener, scale)
    rows = good.mapInArrow(lambda batches: _rows(batches, whitener, scale), schema)
    return rows.select("vec_id", "component", F.lit(whitener.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op13_whitening": op13_whitening}
SQL: dict[str, str] = {}
