"""Documents as a data source: units of files, files written whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from inkveil.sources import datasource, files


@pytest.fixture
def folder(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.txt").write_text("一つ 03-1234-5678", "utf-8")
    (tmp_path / "a/b/two.html").write_text("<p>x</p><p>y &amp; z</p>")
    (tmp_path / "a/b/THREE.TXT").write_text("")
    (tmp_path / "a/other.bin").write_bytes(b"\xff")
    (tmp_path / "a/_hidden.txt").write_text("no")
    return tmp_path


def _tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_units(spark, folder):
    got = spark.read.format(datasource.NAME).load(f"{folder}/a")
    assert got.schema.simpleString() == "struct<path:string,n:int,text:string>"
    rows = sorted((os.path.relpath(r["path"], folder / "a"), r["n"], r["text"]) for r in got.collect())
    assert rows == [("b/THREE.TXT", 0, ""), ("b/two.html", 0, "x"), ("b/two.html", 1, "y &amp; z"), ("one.txt", 0, "一つ 03-1234-5678")]
    plain = files.units(files.read(spark, [f"{folder}/a", f"{folder}/a/b"])).collect()
    assert sorted(r[2] for r in rows if not r[0].startswith("b/THREE")) == sorted(r["text"] for r in plain if r["text"] and "hidden" not in r["path"] and r["text"] != "no")
    small = spark.read.format(datasource.NAME).option("partitionBytes", 1).load(f"file://{folder}/a")
    assert small.rdd.getNumPartitions() == 3 and small.count() == 4
    assert spark.read.format(datasource.NAME).load(f"{folder}/a/one.txt").count() == 1
    (folder / "empty").mkdir()
    assert spark.read.format(datasource.NAME).load(f"{folder}/empty").count() == 0


def test_files_are_written_whole_or_not_at_all(spark, folder):
    out = folder / "out"
    rows = spark.range(20).select(F.format_string("d%d/f%d.txt", F.col("id") % 3, "id").alias("path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content")).repartition(5)
    rows.write.format(datasource.NAME).mode("append").save(str(out))
    assert _tree(out) == sorted(f"d{i % 3}/f{i}.txt" for i in range(20)) and (out / "d1/f7.txt").read_text() == "7"
    before = _tree(folder)
    for i, bad in enumerate((rows, rows.union(rows).withColumn("path", F.lit("same.txt")), rows.withColumn("path", F.lit("../x.txt")), rows.withColumn("content", F.when(F.col("path") == "d1/f7.txt", F.raise_error(F.lit("no")).cast("binary")).otherwise(F.col("content"))))):
        with pytest.raises(Exception):  # noqa: B017
            bad.write.format(datasource.NAME).mode("append").save(str(out))
        assert _tree(folder) == before, i
    rows.withColumn("content", F.lit(b"new")).write.format(datasource.NAME).mode("overwrite").save(str(out))
    assert _tree(folder) == before and (out / "d1/f7.txt").read_text() == "new"


def test_masked_files_by_executors(spark, folder):
    out, _ = files.mask_files(files.read(spark, [f"{folder}/a/one.txt"]), only_rules=True)
    named = out.select(F.concat(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1), F.lit("_masked"), F.col("ext")).alias("path"), "content")
    named.write.format(datasource.NAME).mode("append").save(f"{folder}/masked")
    assert (folder / "masked/one_masked.txt").read_text("utf-8") == "一つ 【電話A】"
