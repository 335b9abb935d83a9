"""Nearest neighbours of vectors of very different lengths, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.llm import neighbours


def _made(kind: str) -> np.ndarray:
    r = np.random.default_rng(11)
    x = r.normal(size=(3000, 24))
    if kind == "lengths":
        x *= r.pareto(0.7, size=(3000, 1)) + 0.01
    elif kind == "clusters":
        x = x * 0.02 + r.normal(size=(12, 24))[r.integers(0, 12, 3000)] * r.integers(1, 30, (3000, 1))
    elif kind == "one long":
        x[17] *= 1e200
    elif kind == "tiny and long":
        x[::2] *= 1e-30
        x[1::40] *= 1e30
    elif kind == "copies":
        x = x[r.integers(0, 40, 3000)]
    return x


@pytest.mark.parametrize("kind", ["lengths", "clusters", "one long", "tiny and long", "copies"])
def test_nearest_of_odd_vectors(spark, kind):
    x = _made(kind)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for row in neighbours.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append(row["vec_id"])
    for q in range(0, 3000, 20):
        scores = (x * x[q]).sum(1)
        scores[q] = -np.inf
        assert found[q] == np.lexsort((np.arange(3000), -scores))[:20].tolist()


def test_lists_are_packed_and_split():
    homes = neighbours.packed_lists(np.array([3, 0, 5, 25, 4, 10]), 10)
    assert homes.tolist() == [[0, 1], [0, 0], [0, 1], [1, 3], [4, 1], [5, 1]]
