r"""Near duplicates by SimHash: an inverted index of fingerprints by the bytes at their positions, and count filtering.

A text is lower-cased (A-Z) and taken apart into words `[^\x20\x09-\x0D]+`; the XXH64 of each shingle (words joined by a space,
repeats included, fewer words than a shingle has: all of them) votes on the 64 bits. Documents of equal fingerprints are one class from then
on. Fingerprints link at a few differing bits, which can touch as few bytes: at least MATCHES of the eight positional bytes are then the same.

The index has a posting list for the bytes at a set of positions. Any four of eight positions have two in one of the groups
012, 345 and 67, so that lists by the seven pairs within these groups bring every linked pair together. A list of more than LONG
fingerprints is replaced by the lists of its pair with each third position, and one of these by those with each fourth (any two that link share
four); what is still too long is dealt out in tiles, of which every two meet in a task. So a list is never held by
one task beyond its bound, at any size and however alike the texts are, and no pair is lost. Within a list the shared bytes of each pair are tallied; pairs that
reach MATCHES are verified by their differing bits. Pairs that are already connected within their list give no further row, so that a list of n fingerprints gives n - 1 links at
most. Components over all links give the groups.

Nulls: a null, empty or blank text has the fingerprint zero, which links like any other. A row with a null doc_id has a fingerprint and a
null component_id. Rows of one doc_id are judged each by its text, and linked by what they share. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, dropped, flat, gather, texts, word_bounds, written
from .components import components

WORDS, SEED, MOST_BITS = 4, 42, 4
#: Of the eight positional bytes, so many at least are the same where MOST_BITS bits differ.
MATCHES = 8 - MOST_BITS
#: Fingerprints of a posting list that one task compares.
LONG = 2048
#: Lists of more fingerprints than that many are looked up by a join with a table of that many rows at most, else by a shuffle.
SENT_LISTS = 100_000
#: Hashes that are counted at once.
STRETCH = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(body: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's shingles, and the number of shingles before each text (len + 1)."""
    import xxhash

    starts, ends, before = word_bounds(body, offsets)
    joined, at = gather(np.append(body, np.uint8(32)), starts, ends - starts + 1)
    joined[at[1:] - 1] = 32
    n = np.diff(before)
    shingles = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    ahead = np.concatenate([[0], np.cumsum(shingles)])
    first = np.repeat(before[:-1] - ahead[:-1], shingles) + np.arange(ahead[-1])
    last = np.minimum(first + words, np.repeat(before[1:], shingles))
    view, hashed = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    return np.fromiter((hashed(view[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] - 1).tolist(), strict=True)), np.uint64, int(ahead[-1])), ahead


def fingerprints(hashes: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """For each text, the bits that are set in over half of its hashes."""
    votes = np.zeros((len(ahead) - 1, 64), np.int64)
    of = np.repeat(np.arange(len(ahead) - 1), np.diff(ahead))
    for at in range(0, len(hashes), STRETCH):
        bits = np.unpackbits(hashes[at : at + STRETCH].astype(">u8").view(np.uint8)).reshape(-1, 64)
        own = of[at : at + STRETCH]
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        votes[own[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > np.diff(ahead)[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def _fingerprinted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        body, offsets = flat(batch.column("text"))
        values = fingerprints(*shingle_hashes(_LOWER[body], offsets, words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def _mask(positions: tuple[int, ...]) -> int:
    """All bits of the bytes at these positions, as a signed long."""
    value = sum(0xFF << 8 * p for p in positions)
    return value - (1 << 64) if value >> 63 else value


#: The pairs of positions of which two fingerprints with four equal bytes share one at least.
PAIRS = tuple(pair for group in ((0, 1, 2), (3, 4, 5), (6, 7)) for pair in combinations(group, 2))


def _postings(prints: DataFrame) -> DataFrame:
    """mask (which bytes), value (these bytes) and fp: each fingerprint in its lists."""
    lists = F.array(*(F.lit(_mask(pair)) for pair in PAIRS))
    return prints.select(F.explode(lists).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def _longer(postings: DataFrame) -> DataFrame:
    """The same postings in lists by one more position, each list once."""
    positions = F.array(*(F.lit(_mask((p,))) for p in range(8)))
    wider = postings.select("mask", "fp", F.explode(positions).alias("more")).where(F.col("mask").bitwiseAND(F.col("more")) == 0)
    return wider.select(F.col("mask").bitwiseOR(F.col("more")).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp").distinct()


def _tiled(postings: DataFrame, long: int) -> DataFrame:
    """Postings of lists that stay too long, whose size is the column n: every two tiles of a list are a list of their own."""
    tiles = F.ceil(2 * F.col("n") / long).cast("long")
    own = F.pmod(F.xxhash64("fp"), tiles)
    met = postings.select("mask", "value", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other"), tiles.alias("n"))
    return met.select("mask", "value", (F.least("own", "other") * F.col("n") + F.greatest("own", "other")).alias("tile"), "fp")


def lists_of(prints: DataFrame, long: int = LONG) -> tuple[DataFrame, list[DataFrame]]:
    """mask, value, tile and fp: posting lists of about so many fingerprints at most, in some of which every two that could link meet; and the tables that they are read from."""
    postings, done, tables = _postings(prints), [], []
    for width in range(2, MATCHES + 1):
        sizes = written(postings.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > long), "long-lists")
        tables.append(sizes)
        many = sizes.count()
        if not many:
            return _together([*done, postings]), tables
        marked = postings.join(F.broadcast(sizes) if many <= SENT_LISTS else sizes, ["mask", "value"], "left")
        done.append(marked.where("n is null").select("mask", "value", "fp"))
        postings = marked.where("n is not null")
        if width < MATCHES:
            postings = written(_longer(postings), "postings")
            tables.append(postings)
    return _together(done).unionByName(_tiled(postings, long)), tables


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("mask", "value", F.lit(0).cast("long").alias("tile"), "fp")


def shared_bytes(differing: np.ndarray) -> np.ndarray:
    """In how many of their eight bytes two fingerprints are the same, by the bits in which they differ."""
    some = differing | differing >> np.uint64(4)
    some |= some >> np.uint64(2)
    some |= some >> np.uint64(1)
    return 8 - np.bitwise_count(some & np.uint64(0x0101010101010101))


def _joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links join two trees of the forest parent (each node's root), which is brought up to date."""
    found = np.zeros(len(i), bool)
    root = {}

    def of(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    for k, (a, b) in enumerate(zip(parent[i].tolist(), parent[j].tolist(), strict=True)):
        a, b = of(a), of(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            found[k] = True
    if root:
        moved = np.arange(len(parent))
        moved[list(root)] = [of(x) for x in root]
        parent[:] = moved[parent]
    return found


def links_within(group: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in each run of equal groups: pairs whose tally of shared bytes and whose differing bits allow it."""
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    stop = np.repeat(bounds[1:], np.diff(bounds))
    parent, i, step = np.arange(len(group)), np.arange(len(group)), 0
    left, right = [], []
    while len(i):
        step += 1
        i = i[i + step < stop[i]]
        differing = prints[i] ^ prints[i + step]
        near = np.flatnonzero(shared_bytes(differing) >= 8 - bits)
        near = near[np.bitwise_count(differing[near]) <= bits]
        near = near[parent[i[near]] != parent[i[near] + step]]
        if len(near):
            a, b = i[near], i[near] + step
            new = _joined(parent, a, b)
            left.append(a[new])
            right.append(b[new])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _tallied(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """From postings in order of their lists, the links of each."""
    held: list[np.ndarray] = []

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        *key, prints = columns
        fresh = np.zeros(len(prints), np.int64)
        fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        a, b = links_within(np.cumsum(fresh), prints.view(np.uint64), bits)
        return pa.RecordBatch.from_arrays([pa.array(prints[a]), pa.array(prints[b])], ["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
        last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in held[:-1]])) if len(held[0]) else []
        if len(last):
            cut = int(last[-1]) + 1
            yield links([c[:cut] for c in held])
            held = [c[cut:] for c in held]
    if held and len(held[0]):
        yield links(held)


def near_duplicates(docs: DataFrame, words: int = WORDS, long: int = LONG) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the least doc_id that links reach, its own included) of each row of docs."""
    every = written(texts(docs).mapInArrow(lambda batches: _fingerprinted(batches, words), "doc_id long, fp long"), "fingerprints")
    classes = written(every.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    lists, tables = lists_of(classes.select("fp"), long)
    links = written(lists.repartition("mask", "value", "tile").sortWithinPartitions("mask", "value", "tile").mapInArrow(lambda batches: _tallied(batches, MOST_BITS), "a long, b long").distinct(), "near")
    dropped(*tables)
    joined = components(links)
    dropped(links)
    placed = classes.join(joined.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "node", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("node").alias("component_id"))
    final = placed.join(least, "component").select("fp", "component_id")
    out = every.join(final, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_simhash": op12_simhash}
SQL: dict[str, str] = {}
