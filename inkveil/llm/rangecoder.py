"""Files of token ids, packed by an adaptive context-mixing range coder, in blocks that reset and are checked on their own.

A block begins with its distinct ids; from there on an id is its rank among these. For each id three orders give a
distribution: order 2 predicts what last followed the two last ids, order 1 what last followed the last one (each with
a confidence that hits raise and misses lower), and order 0 has the counts of the block's ids so far, brought up to date
at growing distances. The distributions are mixed: an id's probability is the weighted sum of the three, and after
each id the weights, kept for each pair of confidences, move towards the orders' shares in its probability. The mixed
probability drives a range coder with 48 bits of state and 16-bit digits, whose carries are settled at the end.

All blocks of a segment are coded side by side, an id of each at a time, both ways, by the same arithmetic in whole numbers
and single IEEE additions, products and quotients, so that it comes out alike on every machine. A file is a Parquet table of
segments: part and seq (its place in the order), doc_ids, doc_tokens, and blocks of n, crc32 (of the ids as little-endian
unsigned 32-bit integers) and payload. A reader that finds another checksum fails. Ids from 2 ** 16 on are refused.

Documents are written in ascending order of doc_id (null first, ties by text) and get their ids and one more, END_ID. Nulls:
a null text is empty: the end id alone. Rows that repeat are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordbpe
from .common import chunks, flat, shared_folder, texts

BLOCK, END_ID = 4096, 2
SEGMENT_BYTES, PART_BYTES = 32 << 20, 22 << 20
#: Blocks that are coded side by side.
LANES = 4096
#: Order 0 has 2 ** SHARES shares, the mixture one less than 2 ** WHOLE; order 0 keeps a weight of LEAST at least, so that each rank has one.
SHARES, WHOLE = 13, 19
ALL, LEAST = (1 << WHOLE) - 1, 2 << SHARES
#: Order 2's table has so many slots a block.
SLOTS = 11
#: Weights are whole numbers of which 2 ** 16 make one. They move by RATE at every EVERY-th id; none falls under FAINT.
EVERY, RATE, FAINT = 4, np.float32(1 / 12), np.float32(128)
FIRST_COUNT = 24
_U = np.uint64
_DIGIT, _HALF, _LOW32, _STATE = _U(16), _U(32), _U(2**32 - 1), _U(2**48)
_SIZE = (1 << SHARES) - 1


class Model:
    """What coder and decoder share: the weights and predictions of each lane (block), and what they learn from each id's rank.

    Arrays of two rows hold order 2 and order 1.
    """

    def __init__(self, sizes: np.ndarray):
        """sizes: the number of distinct ids of each lane, one at least."""
        lanes = len(sizes)
        self.sizes, self.base = sizes, np.cumsum(sizes) - sizes
        self.cells = int(sizes.sum())
        self.lane_of_cell = np.repeat(np.arange(lanes), sizes)
        self.rank_of_cell = np.arange(self.cells) - self.base[self.lane_of_cell]
        # slots of order 2, then a cell for each rank for order 1: the predicted rank << 2 | confidence
        self.after = np.zeros((lanes << SLOTS) + self.cells, np.int16)
        self.lane2, self.base1 = np.arange(lanes) << SLOTS, (lanes << SLOTS) + self.base
        # by lane and context: 16 * (both predict the same) + 4 * confidence of order 2 + that of order 1
        sure = np.stack([np.arange(32) >> 2 & 3, np.arange(32) & 3])
        first = np.maximum(sure * 10000, int(FAINT)).astype(np.uint32)
        self.weight = np.tile(first[0] << 16 | first[1], lanes)  # both orders' in one number
        self.lane_context = np.arange(lanes) << 5
        self.at, self.one, self.two = np.zeros((2, lanes), np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.counts = np.zeros(self.cells, np.int64)
        self.n, self.held, self.next = 0, [], FIRST_COUNT
        self._count()

    def _count(self) -> None:
        """Order 0: of each rank the place where its shares begin << SHARES | their number less one."""
        for cells in self.held:
            self.counts[cells] += 1  # a lane has one in each
        self.held = []
        before = np.cumsum(self.counts) - self.counts
        before -= before[self.base][self.lane_of_cell]
        n, sizes = self.n, self.sizes[self.lane_of_cell]
        begin = self.rank_of_cell + before * ((1 << SHARES) - sizes) // n if n else (self.rank_of_cell << SHARES) // sizes
        end = np.append(begin[1:], 0)
        end[self.base + self.sizes - 1] = 1 << SHARES
        self.shares = (begin << SHARES | end - begin - 1).astype(np.uint32)
        self.next = max(FIRST_COUNT, n + (n >> 1))

    def places(self) -> np.ndarray:
        """The rank that each of a lane's shares belongs to."""
        return np.repeat(self.rank_of_cell.astype(np.uint16), (self.shares & _SIZE).astype(np.int64) + 1)

    def predict(self) -> None:
        at = self.at
        np.add((self.one * 40503 + self.two * 30011 >> 3) & (1 << SLOTS) - 1, self.lane2, out=at[0])
        np.add(self.one, self.base1, out=at[1])
        self.guess = self.after.take(at)
        self.rank, self.sure = self.guess >> 2, self.guess & 3
        self.context = self.lane_context + (self.sure[0] * np.int16(4) + self.sure[1] + (self.rank[0] == self.rank[1]) * np.int16(16))
        mix = self.weight.take(self.context)
        self.share = np.empty((2, len(mix)), np.uint32)
        np.right_shift(mix, np.uint32(16), out=self.share[0])
        np.bitwise_and(mix, np.uint32(0xFFFF), out=self.share[1])
        self.share *= np.uint32(1 << WHOLE - 16)
        self.share0 = np.uint32(ALL) - self.share[0] - self.share[1]

    def spans(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By order 0's part of the mixture, where cells begin, and their sizes."""
        shares = self.shares.take(cell)
        begin = shares >> np.uint32(SHARES)
        low = self.share0 * begin >> np.uint32(SHARES)
        return low, (self.share0 * (begin + (shares & np.uint32(_SIZE)) + np.uint32(1)) >> np.uint32(SHARES)) - low

    def span(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the mixed shares of ranks (32-bit) begin, and their number."""
        self.cell = self.base + rank
        low, size = self.spans(self.cell)
        self.hit = self.rank == rank
        below = self.share * (self.rank < rank)
        more = self.share * self.hit
        return low + below[0] + below[1], size + more[0] + more[1]

    def ranks(self, place: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The ranks whose mixed shares have the places: a prediction's if it is there, else what order 0 has when both predictions' weights are left out."""
        low, size = self.spans(self.base + self.rank)
        share, order = self.share, self.rank[0] < self.rank[1]
        same = self.rank[0] == self.rank[1]
        low[1] += share[0] * order
        low[0] += share[1] * (self.rank[1] < self.rank[0])
        size += share
        size[0] += share[1] * same
        past = place >= low
        left = share * past
        rest = place - left[0] - left[1]
        # the least share of order 0 whose mixed place is past rest, and so the one before it; places are under 2 ** 19, so doubles are exact
        near = ((rest.astype(np.float64) + 1) * (1 << SHARES) / self.share0).astype(np.uint32)
        near -= self.share0 * near >> np.uint32(SHARES) > rest
        found = places.take(self.lane_places + near, mode="clip").astype(np.int32)
        inside = past & (place - low < size)
        return np.where(inside[0], self.rank[0], np.where(inside[1], self.rank[1], found))

    def learn(self, rank: np.ndarray, size: np.ndarray) -> None:
        """size: of the rank's mixed share."""
        sure = self.sure
        if not self.n % EVERY:
            mix = self.share.astype(np.float32) * np.float32(2.0 ** (16 - WHOLE))
            due = self.hit * (np.float32(1 << WHOLE) / size.astype(np.float32))  # times the weight: the order's part in the rank's probability
            new = np.maximum(mix + mix * (due - np.float32(1)) * RATE, FAINT)
            new *= np.minimum(np.float32(65535 - (LEAST >> WHOLE - 16)) / (new[0] + new[1]), np.float32(1))
            new = new.astype(np.uint32)
            self.weight[self.context] = new[0] << np.uint32(16) | new[1]
        self.after[self.at] = np.where(self.hit, self.guess + (sure < 3), np.where(sure > 1, self.guess - 1, ((rank << 2) + 1).astype(np.int16)))
        self.held.append(self.cell)
        self.two, self.one = self.one, rank.astype(np.int64)
        self.n += 1
        if self.n == self.next:
            self._count()


class Encoder:
    """low and range of each lane; a digit may have a carry, which goes to the digit before it in the end."""

    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, _STATE)
        self.first = np.arange(lanes) * most
        self.digits, self.at = np.zeros(lanes * most, np.uint32), self.first.copy()

    def narrow(self, begin: np.ndarray, size: np.ndarray) -> None:
        unit = self.range >> _U(WHOLE)
        self.low += unit * begin
        unit *= size
        self.range = unit
        short = np.flatnonzero(unit <= _LOW32)
        low, at = self.low.take(short), self.at.take(short)
        self.digits[at] = low >> _HALF
        self.at[short] = at + 1
        self.low[short] = (low & _LOW32) << _DIGIT
        unit[short] <<= _DIGIT

    def finish(self, ends: np.ndarray) -> list[bytes]:
        """ends: where each lane's digits were when its ids had been coded; three more tell them from others."""
        for _ in range(3):
            self.digits[self.at] = self.low >> _HALF
            self.low = (self.low & _LOW32) << _DIGIT
            self.at += 1
        while (over := np.flatnonzero(self.digits >> 16)).size:  # never at a lane's first digit: low stays under the whole range
            self.digits[over] &= np.uint32(0xFFFF)
            np.add.at(self.digits, over - 1, np.uint32(1))
        return [self.digits[a : b + 3].astype("<u2").tobytes() for a, b in zip(self.first, ends, strict=True)]


class Decoder:
    def __init__(self, payloads: list[np.ndarray]):
        lengths = np.array([len(p) for p in payloads], np.int64)
        self.digits, self.at = np.concatenate([*payloads, np.zeros(8, np.uint16)]).astype(np.uint16), np.cumsum(lengths) - lengths
        self.code, self.range = np.zeros(len(payloads), _U), np.full(len(payloads), _STATE)
        for _ in range(3):
            self.code = self.code << _DIGIT | self.digits[self.at]
            self.at += 1

    def place(self) -> np.ndarray:
        self.unit = self.range >> _U(WHOLE)
        # both have less than 53 bits, and no quotient of theirs is nearer to the next whole number than a double tells
        return np.minimum(self.code.astype(np.float64) / self.unit.astype(np.float64), ALL - 1).astype(np.uint32)

    def narrow(self, begin: np.ndarray, size: np.ndarray) -> None:
        self.code -= self.unit * begin
        self.range = self.unit * size
        short = np.flatnonzero(self.range <= _LOW32)
        at = self.at.take(short)
        self.code[short] = self.code.take(short) << _DIGIT | self.digits.take(at, mode="clip")  # what comes after a lane's digits doesn't matter
        self.range[short] <<= _DIGIT
        self.at[short] = at + 1


def _packed_alphabet(ids: np.ndarray) -> bytes:
    """Ascending ids by their distances: a byte each, or 255 and two bytes."""
    step = np.diff(ids, prepend=-1) - 1
    far = step >= 255
    out = np.minimum(step, 255).astype(np.uint8).tobytes() + step[far].astype("<u2").tobytes()
    return len(ids).to_bytes(2, "little") + int(far.sum()).to_bytes(2, "little") + out


def _alphabet(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block, and its digits."""
    n, n_far = (int.from_bytes(payload[k : k + 2], "little") for k in (0, 2))
    step = np.frombuffer(payload, np.uint8, n, 4).astype(np.int64)
    far = np.flatnonzero(step == 255)
    if len(far) != n_far:
        raise ValueError("a block's ids are damaged")
    step[far] = np.frombuffer(payload, "<u2", n_far, 4 + n)
    return np.cumsum(step + 1) - 1, np.frombuffer(payload, "<u2", offset=4 + n + 2 * n_far)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The payload of each block of at most BLOCK ids under 2 ** 16. Shorter blocks go on with their first id; what they end with is left out."""
    if len(blocks) > LANES:
        return [p for i in range(0, len(blocks), LANES) for p in encode_blocks(blocks[i : i + LANES])]
    lengths = np.array([len(b) for b in blocks], np.int64)
    if not lengths.sum():
        return [b""] * len(blocks)
    ranks, alphabets = np.zeros((int(lengths.max()), len(blocks)), np.int32), []
    place, said = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, bool)
    for lane, block in enumerate(blocks):
        block = np.asarray(block).astype(np.int64)
        if len(block) and (block.min() < 0 or block.max() >= 1 << 16):
            raise ValueError("ids of token files are under 65536")
        said[block] = True
        ids = np.flatnonzero(said)
        said[ids] = False
        place[ids] = np.arange(len(ids))
        ranks[: len(block), lane] = place[block]
        alphabets.append(ids)
    model, coder = Model(np.array([max(1, len(a)) for a in alphabets])), Encoder(len(blocks), 2 * len(ranks) + 4)
    ends, stops = coder.at.copy(), set(lengths.tolist())
    for t, row in enumerate(ranks, 1):
        model.predict()
        begin, size = model.span(row)
        coder.narrow(begin, size)
        model.learn(row, size)
        if t in stops:
            ends[lengths == t] = coder.at[lengths == t]
    return [_packed_alphabet(ids) + payload if len(ids) else b"" for ids, payload in zip(alphabets, coder.finish(ends), strict=True)]


def decode_blocks(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    if len(lengths) > LANES:
        return [ids for i in range(0, len(lengths), LANES) for ids in decode_blocks(payloads[i : i + LANES], lengths[i : i + LANES])]
    if not sum(lengths):
        return [np.zeros(0, np.uint32)] * len(lengths)
    alphabets, digits = zip(*(_alphabet(p) if n else (np.zeros(1, np.int64), np.zeros(3, np.uint16)) for p, n in zip(payloads, lengths, strict=True)), strict=True)
    model, coder = Model(np.array([len(a) for a in alphabets])), Decoder(list(digits))
    model.lane_places = np.arange(len(lengths)) << SHARES
    ranks = np.zeros((max(lengths), len(lengths)), np.int32)
    counted, places = -1, np.zeros(0, np.uint16)
    for row in ranks:
        if counted != model.next:
            counted, places = model.next, model.places()
        model.predict()
        row[:] = model.ranks(coder.place(), places)
        begin, size = model.span(row)
        coder.narrow(begin, size)
        model.learn(row, size)
    return [ids[ranks[:n, lane]].astype(np.uint32) for lane, (ids, n) in enumerate(zip(alphabets, lengths, strict=True))]


SCHEMA = "part int, seq long, doc_ids array<long>, doc_tokens array<long>, blocks array<struct<n:int,crc32:long,payload:binary>>"


def _segments(batches: Iterator[pa.RecordBatch], end: int, name: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    bpe, part, seq = wordbpe.coder(name), TaskContext.get().partitionId(), 0
    held: list[tuple[list, np.ndarray, np.ndarray]] = []
    size = 0

    def segment() -> pa.RecordBatch:
        ids = np.concatenate([h[1] for h in held])
        blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
        coded = [{"n": len(b), "crc32": zlib.crc32(b.astype("<u4").tobytes()), "payload": p} for b, p in zip(blocks, encode_blocks(blocks), strict=True)]
        kind = pa.list_(pa.struct([("n", pa.int32()), ("crc32", pa.int64()), ("payload", pa.binary())]))
        columns = [pa.array([part], pa.int32()), pa.array([seq]), pa.array([[d for h in held for d in h[0]]], pa.list_(pa.int64())), pa.array([np.concatenate([h[2] for h in held])], pa.list_(pa.int64())), pa.array([coded], kind)]
        return pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_ids", "doc_tokens", "blocks"])

    for batch in chunks(batches):
        body, offsets = flat(batch.column("text"))
        if held and size + len(body) > SEGMENT_BYTES:
            yield segment()
            held, size, seq = [], 0, seq + 1
        ids, starts = wordbpe.with_end(*bpe.encode(body, offsets), end)
        held.append((batch.column("doc_id").to_pylist(), ids, np.diff(starts)))
        size += len(body)
    if held:
        yield segment()


def write_ids(docs: DataFrame, path: str, end: int = END_ID, name: str = wordbpe.VOCABULARY) -> None:
    """Writes the ids of all documents, in ascending order of doc_id, to files at path."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = texts(docs).repartitionByRange(max(1, -(-size // PART_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda batches: _segments(batches, end, name), SCHEMA).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch], checksums: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            blocks = row["blocks"]
            decoded = decode_blocks([b["payload"] for b in blocks], [b["n"] for b in blocks])
            for b, ids in zip(blocks, decoded, strict=True):
                if zlib.crc32(ids.astype("<u4").tobytes()) != b["crc32"]:
                    raise ValueError(f"a block of part {row['part']}, segment {row['seq']} has another checksum")
            ids = np.concatenate([*decoded, np.zeros(0, np.uint32)]).astype("<u4")
            ends = np.concatenate([[0], np.cumsum(row["doc_tokens"])]).astype(np.int64)
            n = len(row["doc_ids"])
            if checksums:
                last = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
            else:
                last = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int64()), pa.array(ends[:-1]), pa.array(np.diff(ends)), last]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32" if checksums else "ids"])


def read_ids(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """doc_id, start (the number of ids of all documents before it), n_tokens and ids, or their checksum ids_crc32 instead, of each document in the files at path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a row is a segment
    table = spark.read.schema(SCHEMA).parquet(path)
    sizes = table.select("part", "seq", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    within = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n"))
    # a row for each part, of which there are as many as tasks wrote
    parts, total = [], 0
    for row in sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        parts.append((row["part"], total))
        total += row["n"]
    first = spark.createDataFrame(parts, "part int, first long")
    places = within.join(F.broadcast(first), "part").select("part", "seq", (F.col("first") + F.col("before")).alias("base"))
    docs = table.mapInArrow(lambda batches: _read(batches, checksums), f"doc_id long, part int, seq long, at long, n_tokens long, {'ids_crc32 long' if checksums else 'ids array<int>'}")
    return docs.join(places, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32" if checksums else "ids")


def op2_range_coder(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_ids(spark, path, checksums=True)


QUERIES = {"op2_range_coder": op2_range_coder}
SQL: dict[str, str] = {}
