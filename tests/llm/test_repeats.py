"""The removers' less usual paths: common anchors, whole characters, columns beside, periodic texts."""

import collections

import helpers
import numpy as np
import pytest

from inkveil.llm import fmindex, repeats, suffixes

TEXTS = [(r[0], r[1]) for r in helpers.rows()]
by_key = lambda rows: sorted(rows, key=repr)


@pytest.fixture(scope="module")
def periodic(spark):
    """Texts of few letters and short periods, copies among them."""
    r = np.random.default_rng(3)
    texts = [(i, "".join(r.choice(list("ab "), int(r.integers(0, 400))))) for i in range(20)]
    texts += [(i, t * int(r.integers(1, 40))) for i, t in enumerate(["a", "ab ", "a a b ", "é", "xyz\n"] * 3, 30)]
    texts += [(60, texts[3][1] + "c" + texts[4][1]), (-5, texts[4][1]), (61, None)]
    return texts, spark.createDataFrame(texts, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("common", [0, repeats.COMMON])
def test_passages(spark, docs, periodic, common):
    shape = repeats.Shape(50, 16, False, 3, common)
    for texts, table in ((TEXTS, docs), periodic):
        got = repeats.without_repeats(table, shape, suffixes.least_ids, suffixes._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        assert by_key(map(tuple, got.collect())) == by_key(helpers.brute_passages(texts))


@pytest.mark.parametrize("common", [0, repeats.COMMON])
def test_windows(spark, docs, periodic, common):
    shape = repeats.Shape(35, 8, True, 3, common)
    for texts, table in ((TEXTS, docs), periodic):
        got = repeats.without_repeats(table, shape, fmindex.repeated, fmindex._digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
        assert by_key(map(tuple, got.collect())) == by_key(helpers.brute_windows(texts))


def test_whole_characters_and_columns_beside(spark, docs):
    said = "é" * 40
    rows = [(1, f"{said}abc", "x", [1, 2]), (2, f"a{said}日本", None, None), (3, None, "y", [3]), (2, f"a{said}日本", "z", [])]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept string, block array<int>")
    got = suffixes.without_passages(table)
    assert got.columns == table.columns
    assert by_key((r[0], r[1], r[2], r[3]) for r in got.collect()) == by_key([(1, f"{said}abc", "x", [1, 2]), (2, "a日本", None, None), (3, "", "y", [3]), (2, "a日本", "z", [])])
    whole = {r["doc_id"]: r["text"] for r in suffixes.without_passages(docs).collect()}
    cut = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.remove_passages(docs).collect()}
    assert all(cut[d].decode(errors="ignore").startswith(t[:20]) for d, t in whole.items())


def test_wavelet_tree_counts():
    r = np.random.default_rng(8)
    symbols = np.minimum(r.zipf(1.5, 3000), 60)
    tree = fmindex.WaveletTree(symbols, 62)
    at = r.integers(0, 3001, 500)
    asked = symbols[r.integers(0, 3000, 500)]
    assert tree.rank(asked, at).tolist() == [int((symbols[:b] == s).sum()) for s, b in zip(asked, at, strict=True)]
    count = collections.Counter(symbols.tolist())
    entropy = sum(-n * np.log2(n / 3000) for n in count.values())
    assert sum(tree.length[s] * n for s, n in count.items()) < entropy + 3000


def test_matching_statistics_report_all_windows():
    r = np.random.default_rng(9)
    units = [r.integers(1, 3, int(r.integers(6, 40))) for _ in range(40)]
    symbols = np.concatenate([np.append(u, 0) for u in units])
    length = np.array([len(u) for u in units])
    begin = np.cumsum(length + 1) - length - 1
    index = fmindex.FMIndex(symbols, 3, 41)
    count = collections.Counter(tuple(u[i : i + 6]) for u in units for i in range(len(u) - 5))
    found = {(u, i) for u, a, b in zip(*fmindex.repeated_windows(index, symbols, begin, length, 6), strict=True) for i in range(a, b)}
    assert found == {(k, i) for k, u in enumerate(units) for i in range(len(u) - 5) if count[tuple(u[i : i + 6])] > 1}
