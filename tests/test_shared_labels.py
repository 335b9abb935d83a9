"""Queries against their SQL where values share the eight digits of their MD5, and labels of four letters."""

import duckdb
import pytest

import __spark_entry__ as entry
from inkveil.plans import crowds

#: Keys whose addresses share these digits, two by two.
_CUSTOMERS = [(440060,), (479348,), (448260,), (22352,), (19229,), (1,), (2,), (3,), (4,), (6,), (None,)]
_ORDERS = [(1, 2878, "1-URGENT"), (3, 37156, "1-URGENT"), (5, 88, "1-URGENT"), (7, 48822, "1-URGENT"), (9, 37156, "2-HIGH"), (11, 2878, "2-HIGH"), (12, 5, "2-HIGH"), (13, 6, None)]


def _same(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got = entry.queries()[name](spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=str)


@pytest.mark.parametrize("name", ["restore_addresses", "restore_plain"])
def test_shared_addresses(spark, tmp_path, name):
    spark.createDataFrame(_CUSTOMERS, "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    _same(spark, str(tmp_path), name, "customer")


@pytest.mark.parametrize("name", ["mask_hot_value", "restore_hot_value"])
def test_shared_mails(spark, tmp_path, name):
    spark.createDataFrame(_ORDERS, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    _same(spark, str(tmp_path), name, "orders")


def test_labels_of_any_length():
    wanted = {25: "Z", 26: "AA", 701: "ZZ", 702: "AAA", 18277: "ZZZ", 18278: "AAAA", 475254: "AAAAA"}
    assert {k: duckdb.connect().execute(f"SELECT {crowds._ANY_LABEL.format(k)}").fetchall()[0][0] for k in wanted} == wanted
