"""Texts that hold the tokenizer's added tokens, against a tokenizer as it is read from its file."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from inkveil.llm import packing, rangecoder, wordbpe
from inkveil.llm.common import flat


def test_added_tokens_have_their_ids():
    plain, r = Tokenizer.from_file(public_tokenizers.path(wordbpe.VOCABULARY)), random.Random(4)
    parts = ["a", "B", "é", " ", "\n", "1", "'s", "<", "|", ">", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "̸"]
    texts = ["end of one.<|endoftext|>start of next", "", "<|endof", "text|>", "<|endoftext|>"] + ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(400)]
    ids, starts = wordbpe.coder().encode(*flat(pa.array(texts)))
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == expected
    assert len(expected[0]) == 8 and 49407 in expected[0]


def test_token_files_and_packing(spark, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path(wordbpe.VOCABULARY))
    texts = ["end of one.<|endoftext|>start of next", "plain words", "<|startoftext|> again"]
    path = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    ids = lambda end: {d: np.array([*plain.encode(t, add_special_tokens=False).ids, end], "<u4") for d, t in enumerate(texts)}
    assert {(r["doc_id"], r["ids_crc32"]) for r in packing.op3_packing(spark, path).collect()} == {(d, zlib.crc32(x.tobytes())) for d, x in ids(1).items()}
    at, expected = 0, []
    for d, x in ids(2).items():
        expected.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in rangecoder.op2_range_coder(spark, path).collect()) == expected
