"""Nearest neighbours against brute force, and the pipeline."""

import helpers
import numpy as np
from pyspark.sql import functions as F

from inkveil.llm import jaccard, neighbours


def _vectors(spark, n, same=0):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in (r.normal(size=16) if i >= same else np.ones(16))], "x") for i in range(n)]
    rows += [(None, [1.0] * 16, "x"), (n, None, "x"), (n + 1, [0.0] * 16, "x"), (n + 2, [float("nan")] * 16, "x"), (n + 3, [None] * 16, "x"), (n + 4, [1.0], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), rows[:n]


def test_recall_and_ties(spark):
    table, rows = _vectors(spark, 3000, same=400)
    got = neighbours.search(table, F.col("vec_id") % 20 == 0).collect()
    vectors = np.array([v for _, v, _ in rows], np.float32).astype(np.float64)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q in range(0, 3000, 20):
        scores = (vectors * vectors[q]).sum(1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(3000), -scores))[:20]
        assert sorted(found[q]) == list(range(1, 21))
        hit += len({v for v, _ in found[q].values()} & set(best.tolist()))
        for v, s in found[q].values():
            assert abs(s - scores[v]) < 1e-9
    assert set(found) == set(range(0, 3000, 20)) and hit / (150 * 20) > 0.9
    assert [found[0][k][0] for k in range(1, 21)] == list(range(1, 21))


def test_few_vectors(spark):
    table, _ = _vectors(spark, 5)
    assert neighbours.search(table, F.col("vec_id") == 0).count() == 4
    assert neighbours.search(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[1]
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    near = helpers.brute_components([(d, t) for d, t in ((r[0], r[1]) for r in helpers.rows()) if d in left])
    assert all(d == c for d, c in near.items())
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == set(left)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language", "near_duplicates", "repeated_passages", "packing"] and jaccard.PERCENT == 80
