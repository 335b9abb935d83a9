"""Finding every repeated window of a corpus: what the two passage removers share.

Documents are gathered into blocks, which are written once. A window (so many bytes or words) has an anchor: the first of
the short grams in it whose hash is least. Runs of neighbouring windows with the same anchor make a unit: the text from
the first window's start to the last one's end. Equal windows have equal anchors at equal places, which gives two steps.

First only the hashes of anchors travel, sorted, by range: an anchor that stands once in the corpus (or, if only other documents
count, in one document) tells that no window of its unit is repeated. Most text ends here, at a few bits for each byte.

Then the texts of the other units are dealt out by anchor, so that all that could be equal comes together in a bucket. Equal
units of a block travel once, compressed together with the block's others for the bucket. Units of an anchor that
stands in more than COMMON places are dealt out window by window instead, by the window's hash: then only equal windows come
together, once for each block that has them.

A bucket's judge gets the distinct units (told apart by their bytes) and tells for each window the value it gives: the least
doc_id, or of words -1 for repeated. Answers go back by block, and the blocks' documents are cut there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, in_blocks, pack, pack_ascending, unpack, unpack_ascending
from .common import binary_array, byte_hashes, codes_of, gather, joined_slices, mixed, prefix_sums, span_hashes, with_room, word_bounds, written

#: Bytes of text for each range of anchors and for each bucket: blocks send a row to each, so that there are as many rows as both make.
RANGE_BYTES, BUCKET_BYTES, LEAST = 256 << 20, 96 << 20, 24
#: Anchors of a range that are looked at together.
SLICE = 1 << 18
#: Units are found in stretches of documents of so many symbols.
STRETCH = 1 << 18
#: An anchor in more places than that is dealt out by window.
COMMON = 20_000
ALONE, MET, MANY = range(3)
_PLACE = np.uint64(31)


@dataclass(frozen=True)
class Shape:
    """window and gram in symbols: words, or else bytes. A bucket is judged in so many parts, one after another."""

    window: int
    gram: int
    words: bool
    parts: int
    common: int = COMMON


def normal_words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text as its words, each with a blank after it."""
    starts, ends, before = word_bounds(body, offsets)
    packed, at = joined_slices(body, starts, ends)
    n = len(starts)
    out = np.empty(len(packed) + n, np.uint8)
    blank = np.zeros(len(out), bool)
    blank[at[1:] + np.arange(n)] = True
    out[blank], out[~blank] = 32, packed
    return out, (at + np.arange(n + 1))[before]


def byte_grams(body: np.ndarray) -> np.ndarray:
    """A hash of each 16 bytes."""
    eight = body.astype(np.uint64)
    for size in (1, 2, 4):
        eight = eight[:-size] | eight[size:] << np.uint64(8 * size)
    return mixed(mixed(eight[:-8]) + eight[8:])


class Block:
    """A block's documents, their symbols, and the units of their windows."""

    def __init__(self, row: dict, shape: Shape):
        self.ids, self.offsets, self.body, self.shape = unpack(row["ids"], np.int64), unpack(row["offsets"], np.int64), unpack(row["body"], np.uint8), shape
        if shape.words:
            self.body, self.offsets = normal_words(self.body, self.offsets)
            blanks = np.flatnonzero(self.body == 32)
            self.ends = blanks + 1
            self.starts = np.append(0, self.ends)[: len(blanks)]
            self.first = np.searchsorted(self.starts, self.offsets)  # the number of symbols before each document (len + 1)
            self.sums = prefix_sums(byte_hashes(self.body, self.starts, self.ends))
        else:
            self.first = self.offsets
        self._units()

    def _gram_hashes(self, a: int, b: int) -> np.ndarray:
        """Of the symbols from a to b."""
        n = b - a - self.shape.gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if self.shape.words:
            at = np.arange(a, a + n)
            return span_hashes(self.sums, at, at + self.shape.gram)
        return byte_grams(self.body[a:b])

    def _units(self) -> None:
        """Stretch by stretch: whole documents, as many as fit."""
        found, doc = [], 0
        while doc < len(self.ids):
            stop = max(doc + 1, int(np.searchsorted(self.first, self.first[doc] + STRETCH, "right")) - 1)
            found.append(self._units_of(doc, stop))
            doc = stop
        kinds = (np.int64, np.int64, np.int64, np.uint64)
        self.at, self.windows, self.doc, self.anchor = (np.concatenate([*(f[k] for f in found), np.zeros(0, kind)]) for k, kind in enumerate(kinds))
        self.anchors, self._of = np.unique(self.anchor, return_inverse=True)

    def _units_of(self, doc: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, first = int(self.first[doc]), self.first[doc : stop + 1] - self.first[doc]
        span, window = self.shape.window - self.shape.gram + 1, self.shape.window
        hashes, size = self._gram_hashes(a, a + int(first[-1])), 1
        n = max(0, int(first[-1]) - window + 1)  # places where a window could start
        # the least hash's leading bits, then its place: of equal ones the first
        low = hashes >> _PLACE << _PLACE | np.arange(len(hashes), dtype=np.uint64)
        while 2 * size <= span and len(low) > size:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        low = np.minimum(low[:n], low[span - size : span - size + n]) if n else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(stop - doc), np.diff(first))[:n]
        whole = np.flatnonzero(first[owner + 1] - np.arange(n) >= window)
        place, owner = (low[whole] & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64), owner[whole]
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        # hashes that were the least of many are small; hashed again they spread evenly
        return a + whole[begin], np.diff(np.append(begin, len(whole))), doc + owner[begin], mixed(hashes[place[begin]] ^ np.uint64(0x5851F42D4C957F2D))

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the distinct anchors: which stand in more documents than one (words: in more places), and in how many places."""
        count = np.bincount(self._of, minlength=len(self.anchors))
        if self.shape.words:
            return count > 1, count
        least, most = np.full(len(count), NO_ID), np.full(len(count), np.iinfo(np.int64).min)
        np.minimum.at(least, self._of, self.ids[self.doc])
        np.maximum.at(most, self._of, self.ids[self.doc])
        return least != most, count

    def keep(self, states: list[dict] | None) -> None:
        """Leaves the units whose anchors are met elsewhere; those of common anchors become units of one window, with its hash as anchor."""
        found = sorted(states or [], key=lambda x: x["range"])
        state = np.concatenate([unpack(x["state"], np.uint8) for x in found] or [np.zeros(0, np.uint8)])[self._of]
        kept = np.flatnonzero(state != ALONE)
        one = state[kept] == MANY
        n = np.where(one, self.windows[kept], 1)
        unit = np.repeat(np.arange(len(kept)), n)
        self.at = self.at[kept][unit] + np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
        self.windows, self.doc, self.anchor = np.where(one, 1, self.windows[kept])[unit], self.doc[kept][unit], self.anchor[kept][unit]
        one = one[unit]
        if one.any():
            start, end = self.spans()
            self.anchor[one] = byte_hashes(self.body, start[one], end[one])

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """The units' bytes."""
        last = self.at + self.windows - 1 + self.shape.window
        if self.shape.words:
            return self.starts[self.at], self.ends[last - 1]
        return self.at, last

    def distinct(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct units, in order of bucket and part: one unit's number, and its bucket times the number of parts plus its part; of all units, their distinct one's number; which distinct ones more documents (words: more places) have."""
        start, end = self.spans()
        bucket = (self.anchor % np.uint64(buckets * self.shape.parts)).astype(np.int64)
        code, one = distinct_values(*gather(self.body, start, end - start))
        order = np.argsort(bucket[one], kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        one, of = one[order], number[code]
        many = np.bincount(of, minlength=len(one)) > 1
        if not self.shape.words:
            many = np.bincount(of, weights=self.ids[self.doc] != self.least(of, len(one))[of], minlength=len(one)) > 0
        return one, bucket[one], of, many

    def least(self, of: np.ndarray, n: int) -> np.ndarray:
        """The least doc_id of each distinct unit."""
        out = np.full(n, NO_ID)
        np.minimum.at(out, of, self.ids[self.doc])
        return out


def distinct_values(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each slice among the distinct ones, which are told apart by their bytes, and the place of the first of each."""
    code, values = codes_of(binary_array(body, offsets))
    one = np.full(len(values), -1)
    one[code[::-1]] = np.arange(len(code))[::-1]
    return code, one


def _asked(batches: Iterator[pa.RecordBatch], shape: Shape, ranges: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row, shape)
            many, count = block.asked()
            cuts = np.searchsorted(block.anchors, _range_starts(ranges))
            rows = [(k, row["block"], pack_ascending(block.anchors[a:b]), pack(many[a:b]), pack(np.minimum(count[a:b], 255).astype(np.uint8))) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(many)], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), *[pa.binary()] * 3))], ["range", "block", "anchors", "many", "count"])


def _range_starts(ranges: int) -> np.ndarray:
    return np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows in order of key, those of one key together."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _states(batches: Iterator[pa.RecordBatch], common: int) -> Iterator[pa.RecordBatch]:
    """For each block's anchors of a range whether they stand alone, in places that are a few, or in many; a slice of the range after another."""
    for rows in _grouped(batches, "range"):
        anchors = [unpack_ascending(r["anchors"]) for r in rows]
        state = [np.zeros(len(a), np.uint8) for a in anchors]
        many, count = [unpack(r["many"], np.bool_) for r in rows], [unpack(r["count"], np.uint8) for r in rows]
        longest = max(anchors, key=len)
        slices = -(-sum(map(len, anchors)) // SLICE)
        bounds = np.append(longest[(len(longest) * np.arange(1, slices)) // slices], np.uint64(2**64 - 1))
        cuts = [np.concatenate([[0], np.searchsorted(a, bounds, "right")]) for a in anchors]
        for k in range(slices):
            own = [slice(c[k], c[k + 1]) for c in cuts]
            join = lambda values, own=own: np.concatenate([v[s] for v, s in zip(values, own, strict=True)])
            code = np.unique(join(anchors), return_inverse=True)[1]
            met = np.bincount(code, weights=join(many)) + np.bincount(code) > 1
            told = np.where(met, np.where(np.bincount(code, weights=join(count)) > common, MANY, MET), ALONE).astype(np.uint8)[code]
            for one, s, part in zip(state, own, np.split(told, np.cumsum([s.stop - s.start for s in own])[:-1]), strict=True):
                one[s] = part
        for row, own in zip(rows, state, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([row["range"]], pa.int32()), pa.array([pack(own)], pa.binary())], ["block", "range", "state"])


def _sent(batches: Iterator[pa.RecordBatch], shape: Shape, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row, shape)
            block.keep(row["states"])
            one, part, of, many = block.distinct(buckets)
            bucket, part = np.divmod(part, shape.parts)
            least = block.least(of, len(one))
            start, end = block.spans()
            start, end = start[one], end[one]
            bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                size = end[a:b] - start[a:b]
                text, _ = gather(block.body, start[a:b], size)
                rows.append((int(bucket[a]), row["block"], pack(text), pack(size.astype(np.uint32)), pack(block.windows[one[a:b]].astype(np.uint8)), pack(least[a:b]), pack(many[a:b]), pack(np.bincount(part[a:b], minlength=shape.parts).astype(np.uint32))))
            names = ["bucket", "block", "text", "sizes", "windows", "least", "many", "parts"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), *[pa.binary()] * 6))], names)


#: Of distinct units: their text, offsets in it, windows, least doc_ids and which are repeated as a whole -> a value for each window (NO_ID: none).
Judge = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _answers(batches: Iterator[pa.RecordBatch], judge: Judge, by_id: bool) -> Iterator[pa.RecordBatch]:
    """The answers to the rows of each bucket, judged part by part."""
    for rows in _grouped(batches, "bucket"):
        cuts = [np.concatenate([[0], np.cumsum(unpack(row["parts"], np.uint32).astype(np.int64))]) for row in rows]
        answers: list[list[tuple]] = [[] for _ in rows]
        for part in range(len(cuts[0]) - 1):
            # rows stay compressed, and are opened for each part
            pieces = [_piece(row, cut[part], cut[part + 1]) for row, cut in zip(rows, cuts, strict=True)]
            for answer, found, cut in zip(answers, _judged_part(pieces, judge, by_id), cuts, strict=True):
                if len(found[0]):
                    answer.append((found[0] + cut[part], *found[1:]))
        for row, answer in zip(rows, answers, strict=True):
            if answer:
                unit, a, b, value = (np.concatenate(x) for x in zip(*answer, strict=True))
                columns = (unit.astype(np.uint32), a.astype(np.uint8), b.astype(np.uint8), value)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([row["bucket"]], pa.int32()), *(pa.array([pack(x)], pa.binary()) for x in columns)], ["block", "bucket", "unit", "a", "b", "value"])


def _piece(row: dict, a: int, b: int) -> tuple:
    """Of the units from a to b of a row: their text, sizes, windows, least doc_ids, and which are in more documents."""
    sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
    begin = int(sizes[:a].sum())
    text = unpack(row["text"], np.uint8)[begin : begin + int(sizes[a:b].sum())].copy()
    return text, sizes[a:b], unpack(row["windows"], np.uint8)[a:b].astype(np.int64), unpack(row["least"], np.int64)[a:b].copy(), unpack(row["many"], np.bool_)[a:b].copy()


def _judged_part(pieces: list[tuple], judge: Judge, by_id: bool) -> list[tuple]:
    """For each block's units (text, sizes, windows, least doc_ids, which are in more documents): units, runs of windows from a to b, and their values."""
    text, size, windows, least, many = (np.concatenate(x) for x in zip(*pieces, strict=True))
    none = (np.zeros(0, np.int64),) * 4
    if not len(size):
        return [none] * len(pieces)
    end = np.cumsum(size)
    code, one = distinct_values(text, np.append(0, end))
    n = len(one)
    low, whole = np.full(n, NO_ID), np.bincount(code, weights=many, minlength=n) + np.bincount(code, minlength=n) > 1
    np.minimum.at(low, code, least)
    body, offsets = gather(text, (end - size)[one], size[one])
    value = judge(body, offsets, windows[one], low, whole)
    # runs of equal values within a unit
    unit = np.repeat(np.arange(n), windows[one])
    first = np.cumsum(windows[one]) - windows[one]
    lead = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (value[1:] != value[:-1])]))
    stop = np.append(lead[1:], len(unit))
    keep = value[lead] != NO_ID
    lead, stop = lead[keep], stop[keep]
    run_unit, run_a, run_b, run_value = unit[lead], lead - first[unit[lead]], stop - first[unit[lead]], value[lead]
    per = np.bincount(run_unit, minlength=n)
    at = np.cumsum(per) - per
    base, out = 0, []
    for _, own, _, _, _ in pieces:
        mine = code[base : base + len(own)]
        k = per[mine]
        which = np.repeat(np.arange(len(own)), k)
        run = np.repeat(at[mine] - (np.cumsum(k) - k), k) + np.arange(len(which))
        if by_id:  # a unit of one document that has the least doc_id itself needs no answer
            needed = (run_value[run] < least[base : base + len(own)][which]) | many[base : base + len(own)][which]
            which, run = which[needed], run[needed]
        base += len(own)
        out.append((which, run_a[run], run_b[run], run_value[run]))
    return out


def _marked(batches: Iterator[pa.RecordBatch], shape: Shape, buckets: int, output: Callable[[Block, np.ndarray, dict], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row, shape)
            block.keep(row["states"])
            removed = np.zeros(int(block.first[-1]) + 1, np.int32)
            if row["answers"]:
                one, bucket, of, _ = block.distinct(buckets)
                base = np.searchsorted(bucket, np.arange(buckets) * shape.parts)
                unit = np.concatenate([unpack(x["unit"], np.uint32).astype(np.int64) + base[x["bucket"]] for x in row["answers"]])
                a, b = (np.concatenate([unpack(x[k], np.uint8) for x in row["answers"]]).astype(np.int64) for k in "ab")
                value = np.concatenate([unpack(x["value"], np.int64) for x in row["answers"]])
                order = np.argsort(unit, kind="stable")
                unit, a, b, value = unit[order], a[order], b[order], value[order]
                per = np.bincount(unit, minlength=len(one))
                at, k = np.cumsum(per) - per, per[of]
                place = np.repeat(np.arange(len(of)), k)
                run = np.repeat(at[of] - (np.cumsum(k) - k), k) + np.arange(len(place))
                if not shape.words:
                    earlier = value[run] < block.ids[block.doc[place]]
                    place, run = place[earlier], run[earlier]
                np.add.at(removed, block.at[place] + a[run], 1)
                np.add.at(removed, block.at[place] + b[run] + shape.window - 1, -1)
            yield output(block, np.cumsum(removed[:-1], dtype=np.int32) > 0, row)


def without_repeats(docs: DataFrame, shape: Shape, judge: Judge, output: Callable[[Block, np.ndarray, dict], pa.RecordBatch], schema: str, *more: str) -> DataFrame:
    """output of each block, of which of its symbols are in a window that judge gives a value under the document's doc_id, and of its row, with the columns more."""
    blocks, size, tasks = in_blocks(docs, *more)
    ranges, buckets = (max(LEAST, -(-size // n)) for n in (RANGE_BYTES, BUCKET_BYTES))
    asked = blocks.drop("more").mapInArrow(lambda batches: _asked(with_room(batches), shape, ranges), "range int, block long, anchors binary, many binary, count binary")
    told = asked.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(lambda batches: _states(with_room(batches), shape.common), "block long, range int, state binary")
    # a few bits for each anchor; blocks are joined where they are, as their table is bucketed
    states = written(told.groupBy("block").agg(F.collect_list(F.struct("range", "state")).alias("states")), "states")
    sent = blocks.drop("more").join(states.hint("shuffle_hash"), "block", "left").mapInArrow(lambda batches: _sent(with_room(batches), shape, buckets), "bucket int, block long, text binary, sizes binary, windows binary, least binary, many binary, parts binary")
    found = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _answers(with_room(batches), judge, not shape.words), "block long, bucket int, unit binary, a binary, b binary, value binary")
    # as many partitions as the table of blocks has buckets, so that it is this side that moves
    answers = found.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "unit", "a", "b", "value")).alias("answers"))
    both = blocks.join(states.hint("shuffle_hash"), "block", "left").join(answers.hint("shuffle_hash"), "block", "left")
    return both.mapInArrow(lambda batches: _marked(with_room(batches), shape, buckets, output), schema)


def together(anchor: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """The units in parts of about most in size; units of one anchor are in one part."""
    order = np.argsort(anchor, kind="stable")
    anchor, ends = anchor[order], np.cumsum(size[order])
    lead = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    part = (ends[lead] - size[order][lead]) // most
    cuts = lead[np.append(True, part[1:] != part[:-1])]
    return np.split(order, cuts[1:])
