"""Joins with frequent keys."""

from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from inkveil.functions import joins


def _rows(spark, n=40_000):
    key = F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("v"), (F.col("id") % 5000).cast("string")))
    return spark.range(0, n, 1, 8).select("id", key.alias("k"), F.lit("s").alias("s"))


def test_no_task_gets_the_frequent_key(spark):
    rows = _rows(spark)
    table = rows.where("k is not null").select("s", "k").distinct().withColumn("label", F.concat(F.lit("L"), "k"))
    assert len(joins.frequent(rows, ["s", "k"])) <= joins.TOP
    # small tables aren't sent out and small parts not put together, as if all were large
    set_so = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in set_so}
    for k, v in set_so.items():
        spark.conf.set(k, v)
    try:
        got = joins.join_unique(rows, table, ["s", "k"]).withColumn("p", F.spark_partition_id()).collect()
        plain = rows.join(table, ["s", "k"], "left").withColumn("p", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    cells = lambda some: Counter((r["id"], r["k"], r["label"]) for r in some)
    assert cells(got) == cells(plain) and len(got) == 40_000
    loads = lambda some: sorted(Counter(r["p"] for r in some).values())
    assert loads(plain)[-1] >= 20_000 and loads(got)[-1] <= 2 * median(loads(got))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_nulls_and_empty_tables(spark, how):
    rows = spark.createDataFrame([(1, "a", None), (2, None, "x"), (3, "a", "x"), (3, "a", "x"), (4, "b", "x")], "id int, s string, k string")
    table = spark.createDataFrame([("a", "x", "A")], "s string, k string, label string")
    for some, other in ((rows, table), (rows.limit(0), table), (rows, table.limit(0))):
        got = joins.join_unique(some, other, ["s", "k"], how)
        assert sorted(map(str, got.select("id", "label").collect())) == sorted(map(str, some.join(other, ["s", "k"], how).select("id", "label").collect()))


def test_the_sketch_has_every_frequent_key(spark):
    """Keys of one in TOP rows among many rare ones, whatever the order."""
    n = 60_000
    rows = spark.range(0, n, 1, 8).select(F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64("id"), F.lit(60))).otherwise(F.col("id") + 1000).alias("k"))
    hot = {r["n"] for r in rows.where("k < 60").select(joins._number(["k"]).alias("n")).distinct().collect()}
    assert hot <= set(joins.frequent(rows, ["k"]))
