"""Vector codes and whitening against plain versions, with awkward rows."""

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from inkveil.llm import vectorcodes, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, code string, n long, block string"


def _rows(n=150, width=32, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(size=width)], int(i % 3) if i % 7 else None) for i in range(n)]
    rows += [(n + i, rows[5][1], 1) for i in range(40)]  # copies
    rows += [(3, rows[4][1], 2), (3, rows[3][1], 2), (None, rows[6][1], None)]
    awkward = [None, [], [1.0], [None] * width, [float("nan")] + [0.0] * (width - 1), [float("inf")] * width]
    return [(i, v, l, "x", 1, "y") for i, v, l in rows + [(9000 + i, v, 1) for i, v in enumerate(awkward)]]


def brute_codes(rows, width, parts=16, entries=64, rounds=2, scale=256):
    good = [(i, [math.floor(Fraction(x) * scale) for x in v], l) for i, v, l, *_ in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(good, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    w = width // parts
    books = [[r[1][p * w : p * w + w] for r in order[:entries]] for p in range(parts)]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))

    def nearest(v, p):
        x = v[p * w : p * w + w]
        return min((apart(x, e), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, v, _ in good:
                mine[nearest(v, p)[1]].append(v[p * w : p * w + w])
            books[p] = [[sum(c) // len(c) for c in zip(*mine[k], strict=True)] if k in mine else e for k, e in enumerate(books[p])]
    out, errors = [], defaultdict(int)
    for i, v, l in good:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), l))
        errors[l] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, c, e, errors[l], digest) for i, c, e, l in out), key=str)


def test_codes(spark, tmp_path):
    rows = _rows()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vectorcodes.op11_vector_codes(spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows, 32)


def test_codes_of_large_numbers_and_few_rows(spark):
    for size in (1e3, 1e9, 1e15):
        rows = [(i, [size * (1 if (i + d) % 3 else -1) + i for d in range(16)], 1, "x", 1, "y") for i in range(5)]
        got = vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
        assert sorted(map(tuple, got)) == brute_codes(rows, 16)
    rows = [(1, [1e300] * 16, 1, "x", 1, "y"), (2, [-1e300] * 16, 1, "x", 1, "y"), (3, [0.0] * 16, 1, "x", 1, "y")]
    assert [r["error"] for r in vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()] == [0, 0, 0]
    assert vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA), entries=1).agg({"error": "max"}).first()[0] == 2**63 - 1


def test_codes_of_uneven_parts(spark):
    assert vectorcodes.bounds_of(5, 2) == [(0, 3), (3, 5)]
    rows = [(i, [float(i), 1.0, 2.0, 3.0, 4.0], 1, "x", 1, "y") for i in range(6)]
    got = vectorcodes.compressed(spark.createDataFrame(rows, SCHEMA), parts=2).orderBy("vec_id").collect()
    assert [(r["code"], r["error"]) for r in got] == [(f"{i:02x}00", 0) for i in range(6)]


def test_distances_are_exact_in_each_type():
    for most in (7, 10**4, 10**8, 10**12):
        r = np.random.default_rng(1)
        columns, book = r.integers(-most, most, (3, 20)), r.integers(-most, most, (4, 3))
        plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, e, strict=True)) for e in book] for x in columns.T]
        assert vectorcodes.distances(columns, book).tolist() == plain


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert vectorcodes.compressed(nothing).count() == 0 and whitening.whiten(nothing).count() == 0
    only = spark.createDataFrame([(1, None, 1, "x", 1, "y")], SCHEMA)
    assert vectorcodes.compressed(only).count() == 0 and whitening.whiten(only).count() == 0


@pytest.mark.parametrize("tile", [5, 32, 64])
def test_whitening(spark, tile):
    rows = _rows(400, 48)
    good = [(i, v) for i, v, *_ in rows if v is not None and len(v) == 48 and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good])
    n, sums = len(x), x.sum(0)
    y = (n * x - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = whitening.whiten(table, tile=tile)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.toPandas()
    assert len(got) == 32 * n and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    plain = np.abs(y @ axes / np.sqrt(values))
    deviations = ((n * x - sums) ** 2).sum(1)
    for k in range(1, 33):
        mine = got[got["component"] == k]
        assert np.allclose(sorted(mine["whitened"].abs()), sorted(plain[:, k - 1]), atol=1e-8)
        assert np.allclose(mine["explained"], values[k - 1] / np.trace(y.T @ y / n), rtol=1e-9)
        assert sorted(mine["deviation"]) == sorted(deviations.tolist())
    wide = got.dropna(subset="vec_id").drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    for i, (vec_id, _) in enumerate(good[:100]):
        if vec_id != 3:
            assert np.allclose(np.abs(wide.loc[vec_id]), plain[i], atol=1e-8)
    signs = got[got["vec_id"] == 7].set_index("component")["whitened"] / (y @ axes / np.sqrt(values))[7]
    assert np.allclose(signs.abs(), 1)


def test_whitening_without_variance(spark):
    rows = [(i, [float(i), 2.0, 3.0], 1, "x", 1, "y") for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).orderBy("component", "vec_id").collect()
    assert len(got) == 12 and [r["whitened"] is None for r in got] == [False] * 4 + [True] * 8
    assert {r["explained"] for r in got[4:]} == {0.0} and abs(got[0]["explained"] - 1) < 1e-12 and got[0]["identity_error"] < 1e-9
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 1.0], 1, "x", 1, "y")] * 3, SCHEMA)).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in same)


def test_deviations_are_exact():
    fitted = whitening.Whitener(10**7, (5, 10**15), np.eye(2), np.ones(2), 2.0)
    whole = np.array([[1000, -2000], [0, 10**8]])
    assert list(fitted.deviations(whole)) == [min(sum((10**7 * int(x) - s) ** 2 for x, s in zip(row, (5, 10**15), strict=True)), 2**63 - 1) for row in whole]
    small = whitening.Whitener(3, (5, 10), np.eye(2), np.ones(2), 2.0)
    assert list(small.deviations(np.array([[1, 2]]))) == [(3 - 5) ** 2 + (6 - 10) ** 2]
