"""Many texts looked up at once, text by text the same; work on a row is done once; scans are dealt out by rows."""

import numpy as np
from pyspark.sql import functions as F

from inkveil.functions import tables, text
from inkveil.operators import gazetteer, tagger


def test_places_do_not_cross_texts(spark):
    names = spark.createDataFrame([("人物", "ab"), ("人物", "abcde"), ("組織", "cd")], "category string, name string")
    bits, lengths = gazetteer.filter_of(names)
    texts = ["xabcdex", "a", "bcd", "abab", "𠮷ab", "cde"]
    together = gazetteer.places_of(texts, bits, lengths)
    assert sorted(together) == sorted((i, s, e) for i, t in enumerate(texts) for s, e in gazetteer.places(t, bits, lengths))
    assert {(i, texts[i][s:e]) for i, s, e in together} >= {(0, "ab"), (0, "abcde"), (0, "cd"), (2, "cd"), (3, "ab"), (4, "ab"), (5, "cd")}


def test_tags_of_many_texts(spark):
    rows = spark.createDataFrame([("田中太郎部長は来た",), ("株式会社山田商事へ",), ("鈴木一郎さんと森",)], "text string")
    model = tagger.learn(rows)
    texts = ["田中太郎部長は", "x", None, "", "株式会社山田商事へ鈴木一郎さん", "𠮷田さん", "は来た"]
    assert model.names_of(texts) == [model.names(t) for t in texts] and any(model.names_of(texts))
    for t in filter(None, texts):
        scores = model.scores(t)
        best = scores[0] + model.moves[0]
        for x in scores[1:]:
            best = (best[:, None] + model.moves).max(0) + x
        tags = model.tags(t)
        value = scores[0][tags[0]] + model.moves[0][tags[0]] + sum(model.moves[a][b] + s[b] for a, b, s in zip(tags, tags[1:], scores[1:], strict=False))
        assert np.isclose(value, best.max())


def test_gaps_of_texts_with_marks(spark):
    rows = [("1a22b",), ("a\x01b1c",), ("12",), ("\x011\x01",), ("𠮷3x",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.spans(F.col("t"), "[0-9]+")).collect()]
    assert [[(x["s"], x["e"], x["raw"]) for x in r] for r in got] == [[(0, 1, "1"), (2, 4, "22")], [(3, 4, "1")], [(0, 2, "12")], [(1, 2, "1")], [(1, 2, "3")]]


def test_scans_are_dealt_out_by_rows(spark, tmp_path):
    spark.range(1000).coalesce(4).write.parquet(f"{tmp_path}/t")
    scan = spark.read.parquet(f"{tmp_path}/t")
    parts = tables.spread(scan, 50).rdd.glom().map(len).collect()
    assert sum(parts) == 1000 and max(parts) <= 100 and len(parts) >= 20
