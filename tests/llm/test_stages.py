"""The pipeline's stages against plain versions, on awkward tables."""

import collections

import helpers
import pytest

import corpus_pipeline
from inkveil.llm import langid, quality

stage = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def table(spark, docs):
    """Repeated doc_ids: a good and a bad text, two texts, and the same row twice."""
    rows = helpers.rows()
    again = [(20, "bad", "en", "src", 3, 0.5, "x"), rows[1], rows[1], (1, rows[7][1], "en", "other", None, None, None), (200, rows[7][1], "en", "b", 1, 0.1, "y"), (200, rows[7][1], "en", "a", 1, 0.1, "y")]
    return docs.unionByName(spark.createDataFrame(again, helpers.SCHEMA)).cache()


def test_quality_rules(spark, table):
    got = collections.Counter(map(tuple, stage["quality_rules"](spark, table, "").collect()))
    verdicts = collections.defaultdict(set)
    for r in quality.quality(table.withColumn("said", table["text"]), "said").collect():
        verdicts[r["doc_id"], r["said"], r["lang"]].add(r["kept"])
    assert all(len(v) == 1 for v in verdicts.values())
    expected = collections.Counter(t for t in map(tuple, table.collect()) if t[0] is not None and verdicts[t[0], t[1], t[2]] == {True})
    assert got == expected and sum(got.values()) > 50 and not any(t[1] == "bad" for t in got)


def test_language(spark, table):
    found = langid.identify(table, langid.learn(table), ("doc_id", "text")).collect()
    expected = collections.Counter((r["doc_id"], r["text"]) for r in found if r["__lang_pred"] != "und" and r["__bits"] <= langid.MAX_BITS)
    assert collections.Counter((r["doc_id"], r["text"]) for r in stage["language"](spark, table, "").collect()) == expected


def test_near_duplicates_keep_one_row_of_each_group(spark, table):
    named = table.where("doc_id is not null")
    rows = list(map(tuple, named.collect()))
    near = helpers.brute_components([(t[0], t[1]) for t in rows])
    got = list(map(tuple, stage["near_duplicates"](spark, named, "").collect()))
    assert sorted(t[0] for t in got) == sorted(d for d, c in near.items() if d == c)
    first = {}
    for t in rows:
        if t[0] not in first or (t[1] or "") < (first[t[0]][1] or ""):
            first[t[0]] = t
    assert all(t[1] == first[t[0]][1] for t in got)
    assert sorted(got, key=repr) == sorted(map(tuple, stage["near_duplicates"](spark, named.repartition(7), "").collect()), key=repr)


def test_repeated_passages(spark, table):
    got = stage["repeated_passages"](spark, table, "")
    assert got.columns == table.columns
    first, rank = {}, lambda d: float("inf") if d is None else d
    rows = list(map(tuple, table.collect()))
    for t in sorted(rows, key=lambda t: rank(t[0])):
        b = (t[1] or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], rank(t[0]))
    expected = []
    for t in rows:
        b = (t[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < rank(t[0]):
                gone[i : i + 50] = b"\1" * 50
        at, text = 0, ""
        for c in t[1] or "":
            n = len(c.encode())
            text += "" if any(gone[at : at + n]) else c
            at += n
        expected.append((t[0], text, t[2], t[3], len(text), t[5], t[6]))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(expected)


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
