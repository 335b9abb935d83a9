"""Vectors of doubles are ranked and scored as they are, and rows of one vec_id don't crowd out equal vectors."""

from pyspark.sql import functions as F

from inkveil.llm import neighbours


def test_doubles_are_not_rounded(spark):
    rows = [(i, [1.0 + 1e-9 * i, 0.5]) for i in range(30)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(29, 9, -1))
    assert all(r["score"] == 1.0 * (1.0 + 1e-9 * r["vec_id"]) + 0.25 for r in got)


def test_repeated_rows_of_a_vector(spark):
    rows = [(0, [1.0, 2.0])] * 40 + [(i, [1.0, 2.0]) for i in range(1, 26)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = neighbours.search(table.where("vec_id > 0 or rand(1) < 2"), F.col("vec_id") == 0).select("vec_id").distinct().collect()
    assert {r["vec_id"] for r in got} == set(range(1, 21))
