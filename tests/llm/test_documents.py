"""Operators that look at each document, and those that compare documents, against plain versions."""

import collections
import hashlib
import zlib

import helpers
import numpy as np
import pytest

from inkveil.llm import bytebpe, fmindex, jaccard, langid, licenses, packing, quality, rangecoder, suffixes, wordbpe

TEXTS = [(r[0], r[1]) for r in helpers.rows()]
by_key = lambda rows: sorted(rows, key=repr)


def test_quality(docs, folder, spark):
    got = quality.op9_quality(spark, folder).collect()
    base = [tuple(r)[:6] for r in got]
    assert by_key(base) == by_key([(d, *helpers.brute_quality(t)) for d, t in TEXTS])
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert any(r["kept"] for r in got)


def test_languages(docs, folder, spark):
    got = {(r["doc_id"], r["lang_pred"]): r for r in langid.op5_language(spark, folder).collect()}
    found = {d: lang for d, lang in got}
    assert found[100] == found[101] == found[102] == found[107] == "und"
    checked = [r for r in helpers.rows() if r[1] and len(r[1]) > 100 and r[2] in ("en", "fr")]
    assert np.mean([found[r[0]] == r[2] for r in checked]) > 0.95
    for r in got.values():
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1


def test_suffix_automaton_knows_all_substrings():
    parts = [b"abcbc", b"bcbba", b"abab"]
    states = langid.automaton(b"\0".join(parts))
    known = {p[i:j] for p in parts for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    seen, stack = set(), [(0, b"")]
    while stack:
        state, said = stack.pop()
        for c, to in states[state].items():
            seen.add(said + bytes([c]))
            stack.append((to, said + bytes([c])))
    assert seen == known


def test_licenses(docs):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    row = got[108]
    assert (row["n_base"], row["first_word"], row["base_names"]) == (5, 0, ["apache", "cc-by", "gpl", "mit"])
    labels = [d["label"] for d in row["detections"]]
    assert "gpl-2.0-or-later" in labels and "cc-by-nc-sa-4.0" in labels and "apache-2.0" in labels and "gpl" not in labels and labels.count("mit") == 2
    assert got[100]["n_words"] == 0 and got[100]["detections"] == [] and got[100]["first_word"] is None


def test_near_duplicates(docs):
    got = jaccard.near_duplicates(docs).collect()
    expected = helpers.brute_components([(d, t) for d, t in TEXTS if d is not None])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == expected
    assert len(got) == len(TEXTS) and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert len(set(expected.values())) < len(expected) - 20


def test_prefixes_meet_for_all_alike_sets():
    r = np.random.default_rng(3)
    counts = r.integers(0, 50, 1 << jaccard.SKETCH_BITS)
    for _ in range(300):
        both = r.integers(0, 2**63, r.integers(1, 120), dtype=np.uint64)
        x, y = (np.unique(np.append(both, r.integers(0, 2**63, r.integers(0, 20), dtype=np.uint64))) for _ in range(2))
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= 80 * (len(x) + len(y) - shared):
            (px, mx), (py, my) = jaccard.prefix(x, counts, 5, 80), jaccard.prefix(y, counts, 5, 80)
            assert len(np.intersect1d(px, py)) >= min(mx, my)


def test_passages(docs, folder, spark):
    got = [tuple(r) for r in suffixes.op8_suffixes(spark, folder).collect()]
    assert by_key(got) == by_key(helpers.brute_passages(TEXTS))
    assert sum(r[2] for r in got) > 1000


def test_windows(docs, folder, spark):
    got = [tuple(r) for r in fmindex.op7_fmindex(spark, folder).collect()]
    assert by_key(got) == by_key(helpers.brute_windows(TEXTS))


def test_fm_index_counts():
    r = np.random.default_rng(1)
    symbols = np.append(r.integers(1, 4, 400), 0)
    index = fmindex.FMIndex(symbols, 4, 12)
    said = symbols.tolist()
    for _ in range(200):
        n, at = int(r.integers(1, 9)), int(r.integers(0, 390))
        low, high = np.array([0]), np.array([index.size])
        for c in reversed(said[at : at + n]):
            low, high = index.back(np.array([c]), low, high)
        assert high[0] - low[0] == sum(said[i : i + n] == said[at : at + n] for i in range(len(said)))


def test_suffix_order():
    r = np.random.default_rng(2)
    for n, letters in ((0, 2), (1, 2), (300, 2), (2000, 4), (2000, 255)):
        text = r.integers(0, letters, n).astype(np.uint8)
        text = np.concatenate([text, text[: n // 2], text[5 : n // 3]])
        order, said = suffixes.two_stage(text, 50), text.tobytes()
        ranked = [said[i : i + 50] for i in order]
        assert sorted(order) == list(range(len(text))) and all(a.ljust(50, b"\0") <= b.ljust(50, b"\0") for a, b in zip(ranked, ranked[1:], strict=False))


def test_byte_bpe(folder, spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    path, pattern = bytebpe.vocabulary(bytebpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    peer = tiktoken.Encoding("peer", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for d, t in TEXTS:
        ids = peer.encode_ordinary(t or "")
        expected.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert by_key(tuple(r) for r in bytebpe.op6_byte_bpe(spark, folder).collect()) == by_key(expected)
    encoded = bytebpe.encode(docs)
    back = bytebpe.decode(encoded).collect()
    assert by_key((r["doc_id"], bytes(r["bytes"])) for r in back) == by_key((d, (t or "").encode()) for d, t in TEXTS)
    row = encoded.where("doc_id = 106").first()
    assert row["offsets"][0] == 0 and row["offsets"] == sorted(row["offsets"])


def _ids(text, end):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path(wordbpe.VOCABULARY))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_packing(folder, spark, empty):
    got = [r.asDict() for r in packing.op3_packing(spark, folder).collect()]
    left = collections.Counter((d, len(ids), zlib.crc32(ids.tobytes())) for d, t in TEXTS for ids in [_ids(t, 1)] if len(ids) <= 2048)
    assert not left - collections.Counter((r["doc_id"], r["doc_tokens"], r["ids_crc32"]) for r in got)
    windows = collections.defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    long = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == 105)
    assert len(long) > 1 and sum(n for _, n in long) == len(_ids(TEXTS[105][1], 1)) and all(n == 2048 for _, n in long[:-1])
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_best_fit():
    windows, places = packing.best_fit([7, 6, 4, 3, 3, 1], 10)
    assert windows == [0, 1, 1, 0, 2, 2] and places == [0, 0, 6, 7, 0, 3]


def test_word_bpe_is_the_tokenizers(spark):
    import random

    import pyarrow as pa

    from inkveil.llm.common import flat

    r = random.Random(1)
    parts = ["a", "é", "́", "日", "\U0001f600", " ", "\n", "'", "s", "S", "1", "２", "ß", "İ", "\xa0", "\x00", "\x1c", "-", "=", "̸", "'re", "'LL", "É", "×", "<|endoftext|>", "Ω"]
    texts = ["".join(r.choice(parts) for _ in range(30)) for _ in range(500)] + [t or "" for _, t in TEXTS]
    ids, starts = wordbpe.coder().encode(*flat(pa.array(texts)))
    for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        expected = wordbpe.coder().tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == expected


def test_token_files(folder, spark, tmp_path, docs):
    got = [tuple(r) for r in rangecoder.op2_range_coder(spark, folder).collect()]
    expected, n = [], 0
    for d, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = _ids(t, 2)
        expected.append((d, n, len(ids), zlib.crc32(ids.tobytes())))
        n += len(ids)
    assert by_key(got) == by_key(expected)
    path = str(tmp_path / "ids")
    rangecoder.write_ids(docs, path)
    whole = rangecoder.read_ids(spark, path).where("doc_id = 106").first()
    assert whole["ids"] == _ids(TEXTS[106][1], 2).tolist()


def test_range_coder_round_trip_and_checksum():
    r = np.random.default_rng(0)
    blocks = [np.zeros(0, int), np.zeros(4096, int), np.full(100, 65535), r.integers(0, 65536, 3000), np.tile(r.integers(0, 49000, 37), 100)[:3000], np.minimum(r.zipf(1.3, 4096), 49407)]
    payloads = rangecoder.encode_blocks(blocks)
    back = rangecoder.decode_blocks(payloads, [len(b) for b in blocks])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back, strict=True))
    assert len(payloads[4]) < 1000 and len(payloads[1]) < 100


def test_empty_tables(empty):
    assert quality.quality(empty).count() == 0
    assert langid.identify(empty, langid.learn(empty)).count() == 0
    assert licenses.scan(empty).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0
    assert suffixes.remove_passages(empty).count() == 0 and fmindex.remove_windows(empty).count() == 0
