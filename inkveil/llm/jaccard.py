r"""Joins of documents whose word shingles are alike, with adaptive multi-match prefixes.

A document's set are the 64-bit hashes of its distinct five-word shingles (fewer words: the whole sequence). Equal sets
make a class; from then on a class stands for its documents. Shingles have one order: by the magnitude of a count sketch
of all documents (fixed size), then by hash, so that the common ones come last. A class of n shingles that must share
o = ceil(t n) with any partner has a prefix of n - o + m shingles, and two partners share at least the smaller of their
m. Each class takes the m for which the estimated cost (postings, and candidates by the sketch, of which m must meet)
is least.

Postings come together by shingle. First each class is tried with a leading one of its group (sizes
permitting), in a few rounds, which joins groups of near copies with few trials. Then all pairs of a group that aren't
yet in one component, that share enough prefix shingles and that could still be alike by the places of these are tried:
no link between components is lost, and none is tried within one. Candidates are verified on whole sets.

Nulls: a null or empty text has an empty set and is linked with nothing. Rows of one doc_id count as linked; a row with a
null doc_id gets its n_shingles and a null component_id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_hashes, chunks, dropped, flat, mixed, prefix_sums, span_hashes, texts, word_bounds, written
from .components import components
from .sketches import summed

WORDS, PERCENT = 5, 80
#: The sketch has 2 ** SKETCH_BITS counts, the filter of sets to fetch 2 ** FILTER_BITS.
SKETCH_BITS, FILTER_BITS = 20, 22
MOST_MATCHES = 4
#: The rounds of trials: which of a group's classes leads (from 0, by fewest rare shingles).
TURNS = (0, 1, 4)
#: What a posting costs, in candidates.
POSTING_COST = 0.25
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sets(batch: pa.RecordBatch, words: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, in ascending order."""
    body, offsets = flat(batch.column("text"))
    body = _LOWER[body]
    starts, ends, before = word_bounds(body, offsets)
    sums = prefix_sums(byte_hashes(body, starts, ends))
    first = np.arange(max(0, len(starts) - words + 1))
    every = span_hashes(sums, first, first + words)
    for a, b in zip(before[:-1], before[1:], strict=True):
        if b - a >= words:
            yield np.unique(every[a : b - words + 1])
        else:
            yield span_hashes(sums, np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64)


def _keys(values: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, for its class."""
    return int(mixed(values).sum(dtype=np.uint64).astype(np.int64)), int(mixed(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _classes(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        rows = [(len(s), *_keys(s)) for s in sets(batch, words)]
        n, a, b = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "n", "cls", "check"])


def prefix(values: np.ndarray, counts: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set under the order of counts, and how many of its shingles a partner must share."""
    n = len(values)
    least = -(-percent * n // 100)
    seen = counts[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((values, np.frexp(seen.astype(np.float64))[1]))
    partners = np.cumsum(np.maximum(seen[order] - noise, 1))
    most = min(MOST_MATCHES, least)
    ends = n - least + np.arange(1, most + 1)
    cost = POSTING_COST * ends + partners[ends - 1] / np.arange(1, most + 1) ** 2
    m = int(np.argmin(cost)) + 1
    return values[order[: n - least + m]], m


def _postings(batches: Iterator[pa.RecordBatch], words: int, percent: int, counts: np.ndarray, noise: float) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        done: set[int] = set()
        parts, cls, n, m, at, rare = [], [], [], [], [], []
        for s in sets(batch, words):
            key = _keys(s)[0]
            if len(s) and key not in done:
                done.add(key)
                shingles, matches = prefix(s, counts, noise, percent)
                parts.append(shingles)
                cls.append(key)
                n.append(len(s))
                m.append(matches)
                at.append(np.arange(len(shingles), dtype=np.int32))
                rare.append(int((counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] <= 4 * noise + 4).sum()))
        sizes = [len(p) for p in parts]
        spread = lambda values, kind: pa.array(np.repeat(np.array(values, kind), sizes))
        yield pa.RecordBatch.from_arrays([_signed(np.concatenate([*parts, np.zeros(0, np.uint64)])), spread(cls, np.int64), spread(n, np.int32), spread(m, np.int8), pa.array(np.concatenate([*at, np.zeros(0, np.int32)])), spread(rare, np.int32)], ["shingle", "cls", "n", "m", "at", "rare"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows in order of shingle, whole groups at a time."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1], "left"))
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _could(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether classes i and j could be alike by their sizes and by the places (at, in their order) of a shingle they share."""
    most = np.minimum(at[i], at[j]) + 1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1
    return (100 + percent) * most >= percent * (n[i] + n[j])


def _pairs(i: np.ndarray, j: np.ndarray, cls: np.ndarray, n: np.ndarray, m: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """a < b by class, and for both: the sizes' sum, the fewest shingles to share, and how many follow the shared one."""
    rest = np.minimum(n[i] - at[i], n[j] - at[j]) - 1
    columns = [np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j]), (n[i] + n[j]), np.minimum(m[i], m[j]), rest]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, (np.int64, np.int64, np.int32, np.int8, np.int32), strict=True)], ["a", "b", "sizes", "m", "rest"])


PAIRS = "a long, b long, sizes int, m byte, rest int"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings in order of shingle, n, cls: those of shingles that two classes or more have, each class once."""
    for columns in _grouped(batches):
        shingle, _, cls = columns[:3]
        fresh = np.ones(len(shingle), bool)
        fresh[1:] = (shingle[1:] != shingle[:-1]) | (cls[1:] != cls[:-1])
        columns = [x[fresh] for x in columns]
        same = columns[0][1:] == columns[0][:-1]
        many = np.append(False, same) | np.append(same, False)
        yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in columns], ["shingle", "n", "cls", "m", "at", "rare"])


def _trials(batches: Iterator[pa.RecordBatch], percent: int, turn: int) -> Iterator[pa.RecordBatch]:
    """From postings with components, in order of shingle, n, cls: of each group a few pairs of two components, in proportion to its size.

    Each class is tried with the group's leading one, which has the fewest rare shingles in all (in later turns the next ones);
    those of the leading one's component with the leading one of the others.
    """
    for shingle, n, cls, m, at, rare, comp in _grouped(batches):
        n, at = n.astype(np.int64), at.astype(np.int64)
        lead = np.append(True, shingle[1:] != shingle[:-1])
        first = np.flatnonzero(lead)
        group = np.cumsum(lead) - 1
        ranked = np.lexsort((cls, rare, group))
        size = np.diff(np.append(first, len(shingle)))
        head = ranked[first + np.minimum(turn, size - 1)][group]
        other = ranked[comp[ranked] != comp[head][ranked]]
        second = np.full(len(first), -1)
        second[group[other[::-1]]] = other[::-1]
        target = np.where(comp[head] != comp, head, second[group])
        i = np.flatnonzero(target >= 0)
        j = target[i]
        fit = _could(n, at, i, j, percent)
        yield _pairs(i[fit], j[fit], cls, n, m, at)


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From postings with components, in order of shingle, n, cls: all pairs of a group that are in two components and could be alike."""
    for shingle, n, cls, m, at, _, comp in _grouped(batches):
        n, at = n.astype(np.int64), at.astype(np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1], [True]]))
        stop = np.repeat(bounds[1:], np.diff(bounds))
        i, step = np.arange(len(shingle)), 0
        while len(i):
            step += 1
            i = i[i + step < stop[i]]
            i = i[100 * n[i] >= percent * n[i + step]]  # sizes only grow from here
            j = i + step
            two = comp[i] != comp[j]
            a, b = i[two], j[two]
            fit = _could(n, at, a, b, percent)
            if fit.any():
                yield _pairs(a[fit], b[fit], cls, n, m, at)


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that share as many prefix shingles as they must, and could share enough in all."""
    sums = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("m").alias("m"), F.min("rest").alias("rest"), F.first("sizes").alias("sizes"))
    return sums.where((F.col("shared") >= F.col("m")) & ((100 + percent) * (F.col("shared") + F.col("rest")) >= percent * F.col("sizes"))).select("a", "b")


def _wanted(batches: Iterator[pa.RecordBatch], words: int, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Class and compressed text of the documents whose class the filter lets through, each class once a batch."""
    for batch in chunks(batches):
        got: dict[int, bytes] = {}
        column = batch.column("text")
        for i, s in enumerate(sets(batch, words)):
            if len(s) and wanted[(key := _keys(s)[0]) & ((1 << FILTER_BITS) - 1)] and key not in got:
                text = column[i].as_py().encode()
                got[key] = len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], ["cls", "packed"])


def _alike(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with their texts, those whose sets are alike enough."""
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        place, packed = {}, []
        for keys, column in ((a, "pa"), (b, "pb")):
            for i, key in enumerate(keys):
                if key not in place:
                    place[key] = len(packed)
                    packed.append(batch.column(column)[i].as_py())
        held: list[np.ndarray] = []
        for x in packed:
            held.extend(sets(pa.RecordBatch.from_arrays([pa.array([pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True).decode()])], ["text"]), words))
        keep = []
        for x, y in zip(a, b, strict=True):
            one, two = held[place[x]], held[place[y]]
            both = np.concatenate([one, two])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the pairs a, b of classes, those whose sets are alike enough; and the table of texts that they are read from."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = summed(ends, lambda batch: batch.column("cls").to_numpy() & ((1 << FILTER_BITS) - 1), FILTER_BITS) > 0
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))
    fetched = texts(docs).mapInArrow(lambda batches: _wanted(batches, words, np.unpackbits(sent.value)), "cls long, packed binary")
    fetched = written(fetched.groupBy("cls").agg(F.first("packed").alias("packed")), "sets")
    both = pairs.join(fetched.select(F.col("cls").alias("a"), F.col("packed").alias("pa")), "a").join(fetched.select(F.col("cls").alias("b"), F.col("packed").alias("pb")), "b")
    return both.mapInArrow(lambda batches: _alike(batches, words, percent), "a long, b long"), fetched


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach, its own included) of each row of docs."""
    spark = docs.sparkSession
    every = written(texts(docs).mapInArrow(lambda batches: _classes(batches, words), "doc_id long, n long, cls long, check long"), "classes")
    # the least doc_id of a class names it, once the joins by class are done
    named = every.where("n > 0").groupBy("cls", "check").agg(F.min("doc_id").alias("node"))

    def adds(batch: pa.RecordBatch) -> np.ndarray:
        values = [s for part in chunks(iter([batch])) for s in sets(part, words)]
        return (np.concatenate([*values, np.zeros(0, np.uint64)]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)

    counts = summed(texts(docs), adds, SKETCH_BITS)
    noise = float(np.median(counts))
    sent = spark.sparkContext.broadcast(counts)
    posted = texts(docs).mapInArrow(lambda batches: _postings(batches, words, percent, sent.value, noise), "shingle long, cls long, n int, m byte, at int, rare int").select("shingle", "n", "cls", "m", "at", "rare")
    met = written(posted.repartition("shingle").sortWithinPartitions("shingle", "n", "cls").mapInArrow(_met, posted.schema), "met")
    links = spark.createDataFrame([], "a long, b long")
    for turn, pick in enumerate((*[partial(_trials, turn=k) for k in TURNS], _across)):
        joined = components(links)
        of = joined.select(F.col("a").alias("cls"), "component")
        placed = met.join(of, "cls", "left").withColumn("component", F.coalesce("component", "cls")).select("shingle", "n", "cls", "m", "at", "rare", "component")
        # groups all of one component need no trial; what is left is written, as it is read twice
        open_ = placed.groupBy("shingle").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2").select("shingle")
        left = placed.join(open_, "shingle", "left_semi") if turn else placed
        pairs = left.repartition("shingle").sortWithinPartitions("shingle", "n", "cls").mapInArrow(partial(pick, percent=percent), PAIRS)
        tried = written(_candidates(pairs, percent), "candidates")
        found, fetched = _verified(docs, tried, words, percent)
        before, links = links, written(links.unionByName(found), "near")
        dropped(before, tried, fetched, joined)
    dropped(met)
    nodes = named.select("cls", "node")
    edges = links.join(nodes.select(F.col("cls").alias("a"), F.col("node").alias("na")), "a").join(nodes.select(F.col("cls").alias("b"), F.col("node").alias("nb")), "b")
    parts = components(edges.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    final = named.join(parts.withColumnRenamed("a", "node"), "node", "left").select("cls", "check", F.coalesce("component", "node").alias("component"))
    out = every.join(final, ["cls", "check"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op10_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_jaccard": op10_jaccard}
SQL: dict[str, str] = {}
