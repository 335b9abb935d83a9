"""Byte-level BPE by the tokenizers library over Arrow batches, and its decoding.

The ranks of a tiktoken file become a vocabulary and merges over visible characters, one for each byte. A batch's texts
are taken apart by the pattern, each distinct piece is encoded once (a bounded store keeps pieces between batches), and
ids are gathered for all of the batch at once, with each token's byte offset. Decoding gathers the tokens' bytes by id;
a character that is split over tokens comes together again, as bytes are joined before anything reads characters.

Nulls: a null text is empty (no tokens). doc_id is passed on, null or repeated. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TokenPool, binary_array, chunks, flat, texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pieces that a worker keeps, each of so many characters at most; beyond, it forgets all and begins anew.
KEPT_PIECES, KEPT_LENGTH = 400_000, 64


def byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def _merge(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of token when only merges of lower rank than its own have been made."""
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], most))
        if ranks.get(parts[best] + parts[best + 1], most) >= most:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class ByteBPE:
    """Encodes and decodes by the ranks in a file; each worker reads it once."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, file))}
        table = byte_characters()
        shown = lambda token: "".join(table[b] for b in token)
        merges = [tuple(map(shown, _merge(token, ranks))) for token, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(token) > 1]
        self.model = Tokenizer(BPE(vocab={shown(t): i for t, i in ranks.items()}, merges=[m for m in merges if len(m) == 2], ignore_merges=True)).model
        self.pattern = regex.compile(pattern)
        self.shown = str.maketrans({chr(b): c for b, c in table.items()})
        self.bytes_of = pa.array([token for token, _ in sorted(ranks.items(), key=lambda x: x[1])], pa.large_binary())
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must run from 0 without a gap")
        self.sizes = np.array([len(t) for t in self.bytes_of.to_pylist()])
        self.pool = TokenPool(KEPT_PIECES)

    def _numbers(self, text: str) -> list[int]:
        out, known = [], self.pool.known
        for piece in self.pattern.findall(text):
            number = known.get(piece)
            if number is None:
                ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]
                number = self.pool.add(piece, ids, len(piece) <= KEPT_LENGTH)
            out.append(number)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of ids before each text (len + 1)."""
        self.pool.trim()
        each = [np.array(self._numbers(t), np.int64) for t in texts]
        ids, ends = self.pool.gather(np.concatenate([*each, np.zeros(0, np.int64)]))
        return ids, ends[np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)]

    def token_offsets(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where each token's bytes begin in its text."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        return ends[:-1] - np.repeat(ends[starts[:-1]], np.diff(starts))

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes, and the offsets of the texts in them."""
        body, ends = flat(self.bytes_of.take(pa.array(ids)))
        return body, ends[starts]


_CODERS: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBPE(path, pattern)
    return _CODERS[path, pattern]


def vocabulary(name: str) -> tuple[str, str]:
    """The place of one of the installed vocabulary files, and the pattern of its pieces."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _encoded(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    bpe = coder(*vocabulary(name))
    for batch in chunks(batches):
        ids, starts = bpe.encode(batch.column("text").to_pylist())
        offsets = bpe.token_offsets(ids, starts)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids), lists(offsets)], ["doc_id", "ids", "offsets"])


def encode(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, ids and each token's first byte in the text (array<int>) of each row."""
    return texts(docs).mapInArrow(lambda batches: _encoded(batches, name), "doc_id long, ids array<int>, offsets array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    bpe = coder(*vocabulary(name))
    for batch in batches:
        column = batch.column("ids").fill_null([])
        starts = column.offsets.to_numpy().astype(np.int64)
        body, offsets = bpe.decode(column.flatten().to_numpy(), starts - starts[0])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), binary_array(body, offsets).cast(pa.binary())], ["doc_id", "bytes"])


def decode(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id and the bytes of each row's ids."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, name), "doc_id long, bytes binary")


def _digests(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    bpe = coder(*vocabulary(name))
    decimal = pa.array([f"{i}," for i in range(len(bpe.bytes_of))], pa.large_string())
    for batch in chunks(batches):
        ids, starts = bpe.encode(batch.column("text").to_pylist())
        digits, at = flat(decimal.take(pa.array(ids)))
        said = memoryview(digits)
        ends = at[starts]
        body, offsets = bpe.decode(ids, starts)
        whole = memoryview(body)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(np.diff(starts)),
                pa.array([hashlib.sha256(said[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]),
                pa.array([hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes in one pass, as the digests need neither ids nor bytes outside it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return texts(docs).mapInArrow(lambda batches: _digests(batches, VOCABULARY), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
SQL: dict[str, str] = {}
