"""Of originals that share a label the last of the mapping's lines is restored, as in the reference; against a plain walk through the rows and the SQL."""

import duckdb
import plain
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkveil.operators import masking
from inkveil.plans.catalogue import MAIL

#: Two by two, keys whose addresses share the eight digits of their MD5; the later address isn't the greater one.
_CUSTOMERS = [460364, 80444, 1031040, 121376, 3, 2, 1, 4, None, -4]
#: Orders of such customers, in two sessions, and those without a text: no key, no customer, no session's name.
_ORDERS = [(5, 9664, "1-URGENT"), (3, 34678, "1-URGENT"), (9, 34678, "1-URGENT"), (11, 9664, "2-HIGH"), (13, 34678, "2-HIGH"), (15, 9664, "2-HIGH"), (17, 88, None), (19, 48822, None), (19, 48822, ""), (19, 88, None)]
_ORDERS += [(2, 1, "1-URGENT"), (4, None, "1-URGENT"), (21, None, "1-URGENT"), (None, 1, "2-HIGH"), (None, 99999, "2-HIGH"), (None, None, None)]
#: Such customers' addresses, in an order where the last row, the greatest value and the one that is new last are not the same.
_TEXTS = ["c9664@shop.example", "c34678@shop.example", "c9664@shop.example"]


def _last(session):
    """Originals by their token's label: a later line takes an earlier one's place."""
    return {(category, session.labels[category][md5]): original for (category, original), md5 in session.originals.items()}


def _asked(folder, name, table, columns):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()


def test_addresses(spark, tmp_path):
    spark.createDataFrame([(k,) for k in _CUSTOMERS], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    raw = lambda k: {0: f"東京都千代田区{k}番地", 1: "〒160-0023", 2: "東京支社", 3: "大阪支店"}[k % 4]
    session = plain.Session()
    labels = {k: session.label("住所", raw(k)) for k in sorted(k for k in _CUSTOMERS if k is not None)}
    last = _last(session)
    rest = {0: "{}。", 1: "{} 新宿{k}。", 2: "{}{k}。", 3: "{k}、{}"}
    expected = [(k, None if k is None else rest[k % 4].format(last["住所", labels[k]], k=k)) for k in _CUSTOMERS]
    assert (80444, "東京都千代田区460364番地。") in expected and (121376, "東京都千代田区1031040番地。") in expected
    got = entry.queries()["restore_addresses"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert sorted(_asked(tmp_path, "restore_addresses", "customer", got.columns), key=str) == sorted(expected, key=str)


def test_orders(spark, tmp_path):
    spark.createDataFrame(_ORDERS, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    sessions, labels, expected = {}, {}, []
    mail = lambda o, c: None if o is None or o % 2 and c is None else f"{'c' + str(c) if o % 2 else 'desk'}@shop.example"
    said = lambda o, c: None if mail(o, c) is None else f"k{o} from {mail(o, c)}"
    for o, c, p in sorted((r for r in _ORDERS if said(*r[:2])), key=lambda r: (r[0], plain.hashlib.md5(said(*r[:2]).encode()).hexdigest())):
        labels[o, c, p] = sessions.setdefault(p or "", plain.Session()).label("メール", mail(o, c))
    for o, c, p in _ORDERS:
        expected.append((o, said(o, c) and f"k{o} from {_last(sessions[p or ''])['メール', labels[o, c, p]]}"))
    assert {(5, "k5 from c9664@shop.example"), (3, "k3 from c9664@shop.example"), (15, "k15 from c34678@shop.example"), (21, None)} <= set(expected)
    got = entry.queries()["restore_hot_value"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert sorted(_asked(tmp_path, "restore_hot_value", "orders", got.columns), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("earlier", [[], ["c9664@shop.example"], ["c34678@shop.example"]])
def test_first_appearances_count(spark, earlier):
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    session = plain.Session()
    for text in earlier + _TEXTS:
        session.label("メール", text)
    options = {"rules": (MAIL,), "only_rules": True, "places": True}
    known = masking.mask(frame(earlier), "id", **options)[1].drop("place") if earlier else None
    out, mapping = masking.mask(frame(_TEXTS), "id", mapping=known, **options)
    assert {r["masked"] for r in out.collect()} == {"【メールA】"} and mapping.count() == 2
    assert [r["restored"] for r in masking.restore(out, "id", mapping).collect()] == [_last(session)["メール", "A"]] * 3
    # a mapping without places, as files and stores have it
    assert {r["restored"] for r in masking.restore(out, "id", mapping.select("session", *(F.col(c.split()[0]) for c in masking.MAPPING.split(", ")))).collect()} == {"c9664@shop.example"}
