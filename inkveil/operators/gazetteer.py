"""Custom names of any number, as a table: found in texts in one pass, without a pattern for each.

A filter of fixed bits a name holds hashes of all names and of their first 2, 4, 8, ... characters. Tasks follow each place of a text
as far as the filter has what stands there, and send on what it has as a whole name; a join by the name itself then sorts out what only looks like one.
So the work for a text doesn't grow with the number of names, names may share beginnings, and only the filter is sent to all
tasks: its bits are bounded, beyond which it lets more through but loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.tables import written
from inkveil.functions.text import empty, let, scanned

from . import entities

#: Bits of the filter for each name, and of the whole filter at most (32 MB).
BITS_A_NAME, MOST_BITS = 64, 1 << 28
#: Bits of a slice, in which tasks send what they have set.
SLICE = 1 << 19
PROBES = 4
_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LISTED = f"array<{entities.ENTITY}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """category and name of the lines `category,name` of dictionary files; comments, other lines and unknown categories are passed over."""
    line = lambda c: F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    rows = spark.read.text(path).select(line("value").alias("v")).where("v != '' and not startswith(v, '#') and contains(v, ',')")
    rows = rows.select(line(F.substring_index("v", ",", 1)).alias("c"), line(F.expr("substring(v, instr(v, ',') + 1)")).alias("name"))
    known = F.create_map(*(F.lit(x) for pair in entities.ALIASES.items() for x in pair))
    return rows.select(F.element_at(known, F.col("c")).alias("category"), "name").where("category is not null and name != ''").distinct()


def _usable(names: DataFrame) -> DataFrame:
    """Names that can be found at all: of two characters or more."""
    return names.select("category", "name").where("length(name) > 1").distinct()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _probes(hashes: np.ndarray, length: int, size: int) -> list[np.ndarray]:
    """The bits for strings of a length by their hashes, in a filter of size bits (a power of two)."""
    out, h = [], (hashes ^ np.uint64(length)) * _ODD
    for _ in range(PROBES):
        h = (h ^ (h >> np.uint64(29))) * _BASE
        out.append((h >> np.uint64(32)) & np.uint64(size - 1))
    return out


def _checked(length: int, longest: int) -> bool:
    """Whether beginnings of this length are in the filter: powers of two."""
    return length > 1 and length & (length - 1) == 0 and length <= longest


def _set_bits(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(size, bool)
    for batch in batches:
        for name in batch.column("name").to_pylist():
            h = np.zeros(1, np.uint64)
            points = _points(name)
            for n, c in enumerate(points, 1):
                h = h * _BASE + c + np.uint64(1)
                if n == len(points) or _checked(n, len(points)):
                    # a name and a beginning of its length are told apart
                    for at in [*(_probes(h, n, size) if _checked(n, len(points)) else []), *(_probes(h, -n & 0xFFFF, size) if n == len(points) else [])]:
                        bits[at] = True
    width = min(SLICE, size)
    used = [k for k in range(size // width) if bits[k * width : (k + 1) * width].any()]
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(bits[k * width : (k + 1) * width]).tobytes() for k in used], pa.binary())], ["slice", "bits"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, bits in zip(batch.column("slice").to_pylist(), batch.column("bits"), strict=True):
            own = np.frombuffer(bits.as_py(), np.uint8)
            found[k] = found[k] | own if k in found else own
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([b.tobytes() for b in found.values()], pa.binary())], ["slice", "bits"])


def filter_of(names: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The filter's bits, packed, and the lengths of names, in order."""
    lengths = sorted(r[0] for r in names.select(F.length("name")).distinct().collect())
    size = SLICE
    while size < min(MOST_BITS, BITS_A_NAME * names.count()):
        size *= 2
    schema = "slice int, bits binary"
    out = np.zeros(size // 8, np.uint8)
    width = min(SLICE, size) // 8
    for row in names.select("name").mapInArrow(lambda batches: _set_bits(batches, size), schema).repartition(16, "slice").mapInArrow(_united, schema).collect():
        out[row["slice"] * width : (row["slice"] + 1) * width] |= np.frombuffer(row["bits"], np.uint8)
    return out, lengths


def _has(bits: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    there = np.ones(len(hashes), bool)
    for at in _probes(hashes, length, 8 * len(bits)):
        there &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
    return there


def places(text: str, bits: np.ndarray, lengths: list[int]) -> list[tuple[int, int]]:
    """Start and end of what the filter has as a name: all names, and little else."""
    return [(s, e) for _, s, e in places_of([text], bits, lengths)]


def places_of(texts: list[str], bits: np.ndarray, lengths: list[int]) -> list[tuple[int, int, int]]:
    """The same for many texts at once, with each one's number; places of a text by length, then from the left."""
    points = [_points(t) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    every = np.concatenate(points or [np.zeros(0, np.uint64)])
    at, h, room = np.arange(len(every)), np.zeros(len(every), np.uint64), (begins + sizes)[owner]
    wanted = set(lengths)
    out: list[np.ndarray] = []
    for n in range(1, lengths[-1] + 1 if lengths else 0):
        whole = at + n <= room
        if not whole.all():
            at, h, room = at[whole], h[whole], room[whole]
        if not len(at):
            break
        h = h * _BASE + every[at + n - 1] + np.uint64(1)
        if n in wanted:
            hit = at[_has(bits, h, -n & 0xFFFF)]
            of = owner[hit]
            out.append(np.stack([of, hit - begins[of], hit - begins[of] + n], 1))
        if _checked(n, lengths[-1]) and n < lengths[-1]:
            go_on = _has(bits, h, n)
            at, h, room = at[go_on], h[go_on], room[go_on]
    return [tuple(x) for x in np.concatenate(out).tolist()] if out else []


#: Characters of texts that are looked up at once.
LOOKED_UP = 1 << 18


def _looked_up(batches: Iterator[pa.RecordBatch], bits: np.ndarray, lengths: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(row, text) for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True) if text]
        begin = size = 0
        for k, (_, text) in enumerate(texts):
            size += len(text)
            if size >= LOOKED_UP or k == len(texts) - 1:
                some = texts[begin : k + 1]
                rows = [(some[i][0], s, e, some[i][1][s:e]) for i, s, e in places_of([t for _, t in some], bits, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["row", "s", "e", "raw"])
                begin, size = k + 1, 0


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """row, s, e, raw, cat: every place of every name in texts (row long, text), overlapping ones too."""
    spark, usable = texts.sparkSession, written(_usable(names), "names")
    sent = spark.sparkContext.broadcast(filter_of(usable))
    found = texts.select("row", "text").mapInArrow(lambda batches: _looked_up(batches, *sent.value), "row long, s int, e int, raw string")
    return found.join(usable.withColumnRenamed("name", "raw").withColumnRenamed("category", "cat"), "raw").select("row", "s", "e", "raw", "cat")


def in_order(found: Column) -> Column:
    """array<entity> of a row's occurrences as names are taken: persons first, longer names first (then by code points), each name's places from the left; a place that overlaps the one before of its own name is none."""
    key = lambda x: F.struct((x["cat"] != entities.PERSON).alias("later"), (x["s"] - x["e"]).alias("short"), F.encode(x["raw"], "UTF-32").alias("name"), x["s"].alias("s"), x.alias("x"))
    start = F.struct(F.lit("").alias("name"), F.lit(0).alias("end"))

    def step(last: Column, y: Column) -> tuple[Column, Column]:
        x = y["x"]
        name = F.concat(x["cat"], x["raw"])
        apart = (last["name"] != name) | (x["s"] >= last["end"])
        return F.when(apart, F.struct(name.alias("name"), x["e"].alias("end"))).otherwise(last), F.struct(apart.alias("apart"), x.alias("x"))

    marked = let(F.array_sort(F.transform(found, key)), lambda o: scanned(o, start, step, f"struct<apart:boolean,x:{entities.ENTITY}>"))
    return F.transform(F.filter(marked, lambda y: y["apart"]), lambda y: y["x"])


def listed(df: DataFrame, names: DataFrame, text: str = "text", into: str = "__listed") -> DataFrame:
    """df with the column into: array<entity> of the names (category, name) that each row's text holds, in the order in which they are taken; empty for none.

    Rows are told apart by a number of their own, so df is written once; null texts hold none.
    """
    rows = written(df.withColumn("__number", F.monotonically_increasing_id()), "rows")
    found = occurrences(rows.select(F.col("__number").alias("row"), F.col(text).alias("text")), names)
    by_row = found.groupBy(F.col("row").alias("__number")).agg(F.collect_list(F.struct("s", "e", "raw", "cat")).alias("__found"))
    return rows.join(by_row, "__number", "left").withColumn(into, F.when(F.col("__found").isNull(), empty(entities.ENTITY)).otherwise(in_order(F.col("__found")))).drop("__number", "__found")
