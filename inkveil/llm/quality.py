"""Quality rules: word and line statistics, and perplexity bands under a modified Kneser-Ney model counted by Spark.

The model is one of word bigrams, counted over all documents: words `[^\\x20\\x09-\\x0D]+` in lower case, each digit as one sign,
a mark before a text's first word. A word carries its document's language (the lang column; null is one of its own). Words and
bigrams are hashes, and both grow with the input: neither has a table of fixed size. For the exchange a hash has as many bits
as keep its chance to be another's too under 2^-SPARE_BITS at every size of the input. Each block of documents sends
its distinct bigrams with their counts, sorted, to ranges of the hash, in PASSES over the hashes, so that only a share of them is
under way at a time; a range adds them up in sorted arrays and answers each block with what the others have. Of the blocks that hold a bigram, the one of the least number has it as its own. What
the lower order needs by word (how many bigrams begin with it once, twice or more often, and in all; of how many different words
it comes after) goes the same way: blocks sum it up over their own bigrams, ranges of words add up, and answer the blocks. From
these come the discounts and the interpolation with continuation counts down to the uniform distribution. Blocks then score
their documents. The driver sees sums alone.

Nulls: a null text is empty (n_words 0, base_failed, no perplexity); a null lang is a language of its own. A null or
repeated doc_id is returned as it is, a row for each input row. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import forgotten, in_blocks, pack, pack_ascending, rest_of, shuffles_removed, unpack, unpack_ascending
from .common import SPACE, byte_hashes, chunks, codes_of, flat, left_clean, mixed, repeats, with_room, word_bounds, written

#: Texts are taken together for this many bytes: the more, the fewer distinct bigrams. Workers go through them part by part.
BLOCK_BYTES, PART_BYTES = 6 << 20, 2 << 20
#: Bytes of text for each range of the bigrams' hashes; of a range so many hashes are added up at a time.
RANGE_BYTES, LEAST_RANGES, ADDED_AT_ONCE = 64 << 20, 24, 1 << 19
#: Bigrams and words are asked for in so many passes, each of its share of the hashes, and blocks are scored in as many, each of
#: its share of the blocks: what a pass has shuffled goes before the next begins.
PASSES = 2
#: Bits of a hash beyond those of the number of words that the texts can have at most (a half of their bytes); 64 in all at most.
SPARE_BITS = 20
#: Log-perplexities are counted in steps of 1 / STEPS for the quartiles.
STEPS = 1024
#: A document leaves if its mean log-probability lies more than WIDTH interquartile ranges outside its language's quartiles.
#: Of widths in steps of a quarter the least that keeps 99 in 100 of the clean documents of `labels` (sf0.1, even doc_ids).
#: MIN_RANGE is one step, so that equal documents stay; interquartile ranges are around 200 steps.
WIDTH, MIN_RANGE = 1.5, 1 / STEPS
#: A document is not too predictable if other documents have this share of its bigrams too: then it is its copies that make it so.
COPIED = 0.9
MIN_WORDS, REPEAT_PERCENT = 50, 50

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[SPACE] = 32
_LOWER[48:58] = 48

STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _text_stats(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    body, offsets = flat(batch.column("text"))
    n = batch.num_rows
    starts, ends, before = word_bounds(body, offsets)
    n_words = np.diff(before)
    per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    hashes, doc = byte_hashes(body, starts, ends), np.repeat(np.arange(n), n_words)
    repeated = np.zeros(n, np.int64)
    if len(hashes) > 2:
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        odd = np.uint64(0xD6E8FEB86659FD93)
        triples = mixed(((hashes[whole] * odd + hashes[whole + 1]) * odd + hashes[whole + 2]) * odd + doc[whole].astype(np.uint64))
        twice = whole[repeats(triples)]
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[twice + k] = True
        repeated = np.bincount(doc[covered], minlength=n)
    # lines: every newline ends one, and so does the end of a text
    breaks = np.flatnonzero(body == 10)
    # a newline at the first byte of a text has the place where the text before it ends: the text's end comes first
    order = np.lexsort((np.concatenate([np.ones(len(breaks), np.int8), np.zeros(n, np.int8)]), np.concatenate([breaks, offsets[1:]])))
    line_ends = np.concatenate([breaks, offsets[1:]])[order]
    line_doc = np.concatenate([np.searchsorted(offsets, breaks, "right") - 1, np.arange(n)])[order]
    line_starts = np.concatenate([[0], np.where(np.concatenate([np.ones(len(breaks), bool), np.zeros(n, bool)])[order], line_ends + 1, line_ends)[:-1]]).astype(np.int64)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_doc = line_starts[has_word], line_ends[has_word], line_doc[has_word]
    lines = mixed(byte_hashes(body, line_starts, line_ends) + line_doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    again = pd.Series(lines).duplicated().to_numpy(bool)
    return {
        "n_words": n_words, "word_chars": per_doc(~SPACE[body] & ((body & 0xC0) != 0x80)), "n_symbols": per_doc(SYMBOL[body]),
        "n_dup_lines": np.bincount(line_doc[again], minlength=n), "n_repeat_words": repeated,
    }


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _tongue(name: str | None) -> int:
    """A hash of a language; null has its own."""
    return int.from_bytes(hashlib.sha256(b"-" if name is None else b"+" + name.encode()).digest()[:8], "little")


def words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words before (at first: a mark) and of the words of each text, in its language; the number of words before each text (len + 1)."""
    body, offsets = flat(batch.column("text"))
    starts, ends, before = word_bounds(body, offsets)
    column = batch.column("lang")
    codes, names = codes_of(column.fill_null(""))
    lang = np.array([_tongue(x) for x in names.to_pylist()], np.uint64)[codes]
    lang[column.is_null().to_numpy(zero_copy_only=False)] = _tongue(None)
    own = mixed(byte_hashes(_LOWER[body], starts, ends) + np.repeat(lang, np.diff(before)))
    last = np.append(np.uint64(0), own[:-1])[: len(own)]
    full = np.diff(before) > 0
    last[before[:-1][full]] = mixed(lang[full])
    return last, own, before


def bigrams(first: np.ndarray, second: np.ndarray, bits: int = 64) -> np.ndarray:
    return mixed(first * _ODD + second) >> np.uint64(64 - bits)


def bits_for(size: int) -> int:
    """Bits of the hashes of texts of so many bytes."""
    return min(64, (size // 2).bit_length() + SPARE_BITS)


def _texts_of(row: dict) -> pa.RecordBatch:
    """A block's documents: doc_id, lang and text."""
    offsets = unpack(row["offsets"], np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(unpack(row["body"], np.uint8))])
    return rest_of(row).append_column("text", column)


def _parts(row: dict) -> Iterator[pa.RecordBatch]:
    return chunks(iter([_texts_of(row)]), most=PART_BYTES)


def _distinct(row: dict, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's bigrams, ascending, with their first and second words, and how often it has them; hashes of so many bits."""
    found = []
    for part in _parts(row):
        first, second, _ = words(part)
        keys, at, count = np.unique(bigrams(first, second, bits), return_index=True, return_counts=True)
        found.append((keys, first[at] >> np.uint64(64 - bits), second[at] >> np.uint64(64 - bits), count))
    every, first, second, count = map(np.concatenate, zip(*found, strict=True))
    keys, at, place = np.unique(every, return_index=True, return_inverse=True)
    return keys, first[at], second[at], np.bincount(place, weights=count, minlength=len(keys)).astype(np.int64)


def _bound(k: int, ranges: int, bits: int) -> int:
    """The least hash of a range."""
    return -(-(k << bits) // ranges)


def _dealt(block: int, keys: np.ndarray, values: list[np.ndarray], ranges: int, bits: int) -> pa.RecordBatch:
    """A block's keys (ascending) and what belongs to them, a row for each range."""
    cuts = np.searchsorted(keys, np.array([_bound(k, ranges, bits) for k in range(ranges)], np.uint64))
    rows = [(k, block, pack_ascending(keys[a:b]), _packed([v[a:b] for v in values])) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(keys)], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["range", "block", "keys", "values"])


_DEALT = "range int, block long, keys binary, values binary"
#: Answers to a block, or (without one) a range's kinds.
_ANSWERS = "block long, range int, values binary, kinds array<long>"


def _packed(values: list[np.ndarray]) -> bytes:
    """Whole numbers of the same keys."""
    return pack(np.concatenate(values).astype(np.uint64))


def _unpacked(data: bytes, kinds: int) -> np.ndarray:
    return unpack(data, np.uint64).astype(np.int64).reshape(kinds, -1)


def _answered(answers: list | None, kinds: int) -> np.ndarray:
    """What all ranges have answered to a block, in order of its keys."""
    found = sorted(answers or [], key=lambda x: x["range"])
    return np.concatenate([np.zeros((kinds, 0), np.int64), *(_unpacked(x["values"], kinds) for x in found)], axis=1)


def _within(row: dict, bits: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's bigrams, ascending, those from low to under high, and how often it has them."""
    found = []
    for part in _parts(row):
        first, second, _ = words(part)
        keys = bigrams(first, second, bits)
        found.append(np.unique(keys[(keys >= np.uint64(low)) & (keys <= np.uint64(high - 1))], return_counts=True))
    every, count = map(np.concatenate, zip(*found, strict=True))
    keys, place = np.unique(every, return_inverse=True)
    return keys, np.bincount(place, weights=count, minlength=len(keys)).astype(np.int64)


def _asked(batches: Iterator[pa.RecordBatch], ranges: int, bits: int, turn: int, turns: int) -> Iterator[pa.RecordBatch]:
    """The bigrams of each block in a pass's share of all ranges."""
    low, high = (_bound(k * ranges // turns, ranges, bits) for k in (turn, turn + 1))
    for batch in batches:
        for row in batch.to_pylist():
            keys, count = _within(row, bits, low, high)
            yield _dealt(row["block"], keys, [count], ranges, bits)


class HashArray:
    """Hashes in order, and what the blocks say of them, added up; a stretch of hashes at a time, as sorting takes several times their room."""

    def __init__(self, keys: list[np.ndarray], values: list[np.ndarray]):
        """keys: of each block, in order; values: of each block, a row for each kind of number."""
        self._answers, self._owned = [np.empty(v.shape, np.int64) for v in values], [np.zeros(len(k), np.int8) for k in keys]
        #: Of each kind of number, what _kinds() says of its sums.
        self.kinds = np.zeros((len(values[0]), 6), np.int64)
        held = [k for k in keys if len(k)]
        low, high = min((int(k[0]) for k in held), default=0), max((int(k[-1]) for k in held), default=0)
        parts = sum(map(len, keys)) // ADDED_AT_ONCE + 1
        bounds = np.array([low + (high - low) * k // parts for k in range(1, parts)], np.uint64)
        cuts = np.array([[0, *np.searchsorted(k, bounds), len(k)] for k in keys])
        for a, b in zip(cuts.T[:-1], cuts.T[1:], strict=True):
            self._add(keys, values, a, b)

    def _add(self, keys: list[np.ndarray], values: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> None:
        """The blocks' keys from begin to end."""
        own = [(i, slice(a, b)) for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)) if b > a]
        if not own:
            return
        every, at, place = np.unique(np.concatenate([keys[i][c] for i, c in own]), return_index=True, return_inverse=True)
        first = np.zeros(len(place), np.int8)
        first[at] = 1
        ends = np.cumsum([c.stop - c.start for _, c in own])[:-1]
        for (i, c), x in zip(own, np.split(first, ends), strict=True):
            self._owned[i][c] = x
        for k in range(len(self.kinds)):
            sums = np.bincount(place, weights=np.concatenate([values[i][k, c] for i, c in own]), minlength=len(every)).astype(np.int64)
            self.kinds[k] += _kinds(sums)
            for (i, c), x in zip(own, np.split(sums[place], ends), strict=True):
                self._answers[i][k, c] = x

    def answers(self) -> list[np.ndarray]:
        """The sums of each block's keys."""
        return self._answers

    def owned(self) -> list[np.ndarray]:
        """For each block's keys whether it is the first to have them."""
        return self._owned


def _by_range(batches: Iterator[pa.RecordBatch], kinds: int) -> Iterator[tuple[list[dict], HashArray]]:
    """From rows in order of range: those of each range, and their array."""
    held: list[dict] = []
    array = lambda: HashArray([unpack_ascending(r["keys"]) for r in held], [_unpacked(r["values"], kinds) for r in held])
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["range"] != held[0]["range"]:
                yield held, array()
                held = []
            held.append(row)
    if held:
        yield held, array()


def _answer(block: int | None, at: int, values: bytes | None, kinds: list[int] | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at], pa.int32()), pa.array([values], pa.binary()), pa.array([kinds], pa.list_(pa.int64()))], ["block", "range", "values", "kinds"])


def _kinds(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, how many there are, and their sum."""
    return [*(int((counts == k).sum()) for k in range(1, 5)), int((counts > 0).sum()), int(counts.sum())]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's bigrams in the other blocks: twice the count, and one if the block has it as its own."""
    for held, array in _by_range(batches, 1):
        for row, count, own in zip(held, array.answers(), array.owned(), strict=True):
            others = count - _unpacked(row["values"], 1)
            yield _answer(row["block"], row["range"], _packed([others[0] << 1 | own]), None)
        yield _answer(None, held[0]["range"], None, array.kinds[0].tolist())


#: What is summed up by word: bigrams that begin with it once, twice, more often, and in all; bigrams that end with it.
SUMS = ("once", "twice", "often", "total", "before")


def _known(row: dict, bits: int) -> tuple[np.ndarray, ...]:
    """Of a block whose bigrams are answered: these, their counts over all documents, the places of their first and second words in the block's words, these words, and their SUMS over the bigrams that the block has as its own."""
    keys, first, second, inside = _distinct(row, bits)
    (answer,) = _answered(row["bigrams"], 1)
    count, own = (answer >> 1) + inside, answer & 1
    names, place = np.unique(np.concatenate([first, second]), return_inverse=True)
    a, b = np.split(place, 2)
    summed = lambda of, weight: np.bincount(of, weights=weight * own, minlength=len(names)).astype(np.int64)
    return keys, count, a, b, names, np.stack([summed(a, count == 1), summed(a, count == 2), summed(a, count > 2), summed(a, count), summed(b, np.ones(len(b)))])


def _told(batches: Iterator[pa.RecordBatch], ranges: int, bits: int, turn: int, turns: int) -> Iterator[pa.RecordBatch]:
    """The words of each block in a pass's share of all ranges, with SUMS over the bigrams that it has as its own."""
    low, high = (_bound(k * ranges // turns, ranges, bits) for k in (turn, turn + 1))
    for batch in batches:
        for row in batch.to_pylist():
            *_, names, sums = _known(row, bits)
            own = (names >= np.uint64(low)) & (names <= np.uint64(high - 1))
            yield _dealt(row["block"], names[own], list(sums[:, own]), ranges, bits)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMS of each block's words in the other blocks."""
    for held, array in _by_range(batches, len(SUMS)):
        for row, sums in zip(held, array.answers(), strict=True):
            yield _answer(row["block"], row["range"], _packed(list(sums - _unpacked(row["values"], len(SUMS)))), None)
        yield _answer(None, held[0]["range"], None, array.kinds[SUMS.index("before")].tolist())


def discounts(kinds: np.ndarray) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and more: from how many have a count of 1, 2, 3 and 4; half a count where these give none."""
    n = [0, *map(float, kinds)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    return np.array([0.0, *(max(0.0, min(k, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3))])


class KneserNey:
    """Of the kinds of bigrams and of words by the bigrams that end with them: the discounts, and what is left for the uniform distribution."""

    def __init__(self, pairs: list[int], ends: list[int]):
        self.off, self.lower_off = discounts(np.array(pairs[:4])), discounts(np.array(ends[:4]))
        seen, self.every = ends[4], max(1, ends[5])
        spare = self.lower_off[1] * ends[0] + self.lower_off[2] * ends[1] + self.lower_off[3] * (seen - ends[0] - ends[1])
        self.uniform = spare / (seen + 1)

    def log_probabilities(self, count: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Of bigrams that the documents have so often; first and second: SUMS of their words."""
        once, twice, often, total, _ = first
        before = second[SUMS.index("before")]
        weight = self.off[1] * once + self.off[2] * twice + self.off[3] * often
        lower = (before - self.lower_off[np.minimum(before, 3)] + self.uniform) / self.every
        return np.log((count - self.off[np.minimum(count, 3)] + weight * lower) / total)


def _own_counts(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each bigram of each document how often the document has it."""
    _, at, count = np.unique(doc.astype(np.int64) << 40 | place, return_inverse=True, return_counts=True)
    return count[at]


#: Bigrams whose probabilities are found at a time.
_AT_ONCE = 1 << 17


def _scored(batches: Iterator[pa.RecordBatch], model: KneserNey, more: tuple[str, ...], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            every, count, of_first, of_second, _, sums = _known(row, bits)
            sums += _answered(row["words"], len(SUMS))
            cuts = [slice(k, k + _AT_ONCE) for k in range(0, len(every), _AT_ONCE)]
            logs = np.concatenate([np.zeros(0), *(model.log_probabilities(count[c], sums[:, of_first[c]], sums[:, of_second[c]]) for c in cuts)])
            for docs in _parts(row):
                first, second, before = words(docs)
                keys, place = np.unique(bigrams(first, second, bits), return_inverse=True)
                place = np.searchsorted(every, keys)[place]
                sizes = np.diff(before)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                total = np.bincount(doc, weights=logs[place], minlength=len(sizes))
                columns = {c: docs.column(c) for c in ("doc_id", "lang")} | {k: pa.array(v.astype(np.int64)) for k, v in _text_stats(docs).items()}
                columns["log_perplexity"] = pa.array(-total / np.maximum(sizes, 1), mask=sizes == 0)
                columns["shared"] = pa.array(np.bincount(doc, weights=count[place] > _own_counts(doc, place), minlength=len(sizes)) / np.maximum(sizes, 1), mask=sizes == 0)
                columns |= {c: docs.column(c) for c in more}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _totals(answers: DataFrame) -> list[int]:
    """The ranges' kinds added up."""
    return [x or 0 for x in answers.where("block is null").select(*(F.sum(F.col("kinds")[k]) for k in range(6))).first()]


def _of_blocks(answers: DataFrame, buckets: int, name: str) -> DataFrame:
    """The answers to each block, brought to where the table of blocks has it."""
    return answers.where("block is not null").repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("range", "values")).alias(name))


def model_of(blocks: DataFrame, size: int, buckets: int) -> tuple[DataFrame, KneserNey, list[DataFrame]]:
    """The blocks with the answers to their bigrams and words, the model's numbers, and the tables that were written."""
    bits, share = bits_for(size), max(LEAST_RANGES, -(-size // (RANGE_BYTES * PASSES)))
    tables = []

    def exchanged(rows: DataFrame, ask, task, name: str) -> DataFrame:
        """The ranges' answers, written by the ranges' tasks: what they were asked is still on disk then, and goes before the answers are brought to the blocks."""
        own = []
        for turn in range(PASSES):
            asked = rows.mapInArrow(lambda batches, turn=turn: left_clean(ask(with_room(batches), share * PASSES, bits, turn, PASSES)), _DEALT)
            # in order of block: which of them has a bigram as its own is the same in every run of a task
            told = asked.repartition(share, "range").sortWithinPartitions("range", "block").mapInArrow(lambda batches: left_clean(task(with_room(batches))), _ANSWERS)
            with shuffles_removed(rows.sparkSession):
                own.append(written(told, name))
        tables.extend(own)
        return reduce(DataFrame.union, own)

    counted = exchanged(blocks, _asked, _counted, "bigrams")
    known = blocks.join(_of_blocks(counted, buckets, "bigrams").hint("shuffle_hash"), "block", "left")
    summed = exchanged(known, _told, _summed, "words")
    return known.join(_of_blocks(summed, buckets, "words").hint("shuffle_hash"), "block", "left"), KneserNey(_totals(counted), _totals(summed)), tables


def _stats(docs: DataFrame, *more: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """document_stats() in PASSES parts, and the tables that these read."""
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), *more)
    blocks, size, tasks = in_blocks(plain, "doc_id", "lang", *more, most=BLOCK_BYTES)
    known, model, tables = model_of(blocks, size, tasks)
    schema, bits = StructType([*StructType.fromDDL(f"{STATS}, log_perplexity double, shared double"), *docs.select(*more).schema]), bits_for(size)
    # by high bits of the random numbers of blocks; both sides of a join are filtered before the answers are shuffled
    parts = [known.where(F.shiftright("block", 40) % PASSES == turn) for turn in range(PASSES)]
    return [part.mapInArrow(lambda batches: left_clean(_scored(with_room(batches), model, more, bits)), schema) for part in parts], [blocks, *tables]


def document_stats(docs: DataFrame, *more: str) -> DataFrame:
    """For each row of docs: doc_id, lang, the five counts, and log_perplexity double (per word) and shared double (of its bigrams, the share that other documents have too); both null for a text without words. The columns more are passed on."""
    return reduce(DataFrame.union, _stats(docs, *more)[0])


def bands(stats: DataFrame, width: float = WIDTH) -> DataFrame:
    """lang, low and high: the band of log-perplexities that a language's documents may have, from the quartiles of all of them (in steps of 1 / STEPS)."""
    steps = stats.where("log_perplexity is not null and not base_failed").groupBy("lang", F.floor(F.col("log_perplexity") * STEPS).alias("step")).count()
    running = Window.partitionBy("lang").orderBy("step")
    of = Window.partitionBy("lang")
    share = steps.withColumn("upto", F.sum("count").over(running) / F.sum("count").over(of))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q, F.col("step"))) / STEPS
    got = share.groupBy("lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3")).withColumn("range", F.greatest(F.col("q3") - F.col("q1"), F.lit(MIN_RANGE)))
    return got.select("lang", (F.col("q1") - width * F.col("range")).alias("low"), (F.col("q3") + width * F.col("range")).alias("high"))


def quality(docs: DataFrame, *more: str, width: float = WIDTH) -> DataFrame:
    """Each document's statistics, log_perplexity, shared, the columns more, its language's band low and high, base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated three-word windows. kept: not base_failed, and
    the perplexity within the language's band, or under it with COPIED or more shared with other documents (a language all of
    whose documents fail has no band; nothing is kept).
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    found, tables = _stats(docs, *more)
    parts = []
    for part in found:
        with shuffles_removed(docs.sparkSession):
            parts.append(written(part.withColumn("base_failed", failed), "quality"))
    stats = reduce(DataFrame.union, parts)
    forgotten(*tables)
    limits = bands(stats, width).withColumnRenamed("lang", "band_lang")
    inside = (F.col("log_perplexity") <= F.col("high")) & ((F.col("log_perplexity") >= F.col("low")) | (F.col("shared") >= COPIED))
    return stats.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_perplexity", "shared")


#: The base columns can be told in SQL, the model's verdict cannot: the tests compare with a plain version.
QUERIES = {"op9_quality": op9_quality}
SQL: dict[str, str] = {}
