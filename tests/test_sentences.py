"""Queries over made sentences against their SQL, at the smallest scale; what SQL doesn't show of files and modes."""

import base64

import duckdb
import pytest
from pyspark.sql import functions as F

from inkveil.operators import entities
from inkveil.plans import sentences
from inkveil.sources import files, mappings

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n in sentences.SQL if n.startswith(("names_", "alternatives_")) or n.endswith(("_units", "_previews", "_urls", "_functions"))]
NAMES += ["date_digits", "date_short_in_context", "made_sessions", "mapping_lines", "restore_addresses", "restore_plain"]


@pytest.mark.parametrize("name", NAMES)
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("customer", "orders", "part", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found, expected = sentences.QUERIES[name](spark, FOLDER), con.execute(sentences.SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expected.fetchall())


def test_mapping_as_bytes(spark):
    rows = [("", "電話", "03-1\t2", "AB", "B"), ("", "電話", "03-3", "CD", "A")]
    assert mappings.to_bytes(spark.createDataFrame(rows, mappings.SCHEMA)).decode() == f"{mappings.HEADER}\n電話\t03-3\tCD\tA\n電話\t03-1\\t2\tAB\tB\n"
    assert mappings.to_bytes(spark.createDataFrame([], mappings.SCHEMA)).decode() == f"{mappings.HEADER}\n"


def test_previews_and_data_urls(spark):
    page = base64.b64encode(b"<p>one</p><p>two</p>").decode()
    urls = spark.createDataFrame([("a", f"data:text/html;base64,{page}"), ("b", "https://example.com"), ("c", None), ("d", "data:text/html;base64,***")], "path string, url string")
    found = {r["path"]: r for r in files.from_data_urls(urls, "url").collect()}
    assert (found["a"]["ext"], bytes(found["a"]["content"])) == (".html", b"<p>one</p><p>two</p>")
    assert found["b"]["ext"] is None and found["c"]["content"] is None and found["d"]["content"] is None
    good = files.from_data_urls(urls, "url").where(F.col("path") == "a").select("path", "ext", "content")
    assert files.previews(good).first()["preview"] == "one\ntwo"


def test_modes():
    assert entities.mode() == "辞書＋ヒューリスティック" and entities.mode(object()) == "系列モデル"
