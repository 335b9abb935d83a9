"""Names of a table against the plain version."""

import datetime
import random

import plain

from inkveil.operators import entities, gazetteer, masking

TODAY = datetime.date(2026, 3, 1)


def _names(n=400, seed=2):
    r = random.Random(seed)
    letters = "あいうabc𠮷"
    names = {(r.choice(["人物", "組織"]), "".join(r.choice(letters) for _ in range(r.choice([2, 2, 3, 4, 5, 9, 17])))) for _ in range(n)}
    return sorted(names | {("人物", "abab"), ("組織", "abab"), ("人物", "ab"), ("組織", "a"), ("組織", "12"), ("人物", "ab abab")})


def _texts(n=60, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice("あいうabc𠮷 ") for _ in range(r.choice([0, 3, 40, 400]))) for _ in range(n)] + ["ababab abababab", "ab", "12 12", None]


def test_all_places(spark):
    names, texts = _names(), _texts()
    table = spark.createDataFrame(names, "category string, name string").union(spark.createDataFrame(names[:9], "category string, name string"))
    got = gazetteer.occurrences(spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3), table).collect()
    expected = sorted((i, s, s + len(n), n, c) for i, t in enumerate(texts) for c, n in names if len(n) > 1 for s in range(len(t or "")) if t.startswith(n, s))
    assert sorted(map(tuple, got)) == expected


def test_same_as_custom_names(spark):
    names, texts = _names(120, 3), _texts(40, 8)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    found = masking.mask_rows(masking.detect(df, today=TODAY, gazetteer=spark.createDataFrame(names, "category string, name string"))).collect()
    for r in found:
        assert r["masked"] == (None if texts[r["id"]] is None else plain.Session().mask(texts[r["id"]], TODAY, names))
    few = [n for n in names if len(n[1]) > 3][:15]
    one = masking.mask_rows(masking.detect(df, today=TODAY, custom=few)).select("id", "masked").collect()
    two = masking.mask_rows(masking.detect(df, today=TODAY, gazetteer=spark.createDataFrame(few, "category string, name string"))).select("id", "masked").collect()
    assert sorted(one, key=lambda r: r["id"]) == sorted(two, key=lambda r: r["id"])


def test_long_texts_with_a_table(spark):
    r = random.Random(1)
    names = [("人物", "quick fox"), ("組織", "犬、猫"), ("組織", "株式")]
    body = "".join(r.choice(["the quick fox runs ", "犬、猫。", "株式会社アルファ、", "quick fox"]) for _ in range(300))
    for some in (names, names[:1] + names[2:], names[2:]):
        table = spark.createDataFrame(some, "category string, name string")
        out, _ = masking.mask(spark.createDataFrame([(1, body)], "id long, text string"), "id", part_chars=50, today=TODAY, gazetteer=table)
        assert out.first()["masked"] == plain.Session().mask(body, TODAY, some)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "category string, name string")
    texts = spark.createDataFrame([(1, "abab")], "row long, text string")
    assert gazetteer.occurrences(texts, none).count() == 0
    assert gazetteer.occurrences(texts.limit(0), spark.createDataFrame(_names(), "category string, name string")).count() == 0


def test_dictionary_files(spark, tmp_path):
    lines = ["# note", "人名, 田中太郎 ", " ORG,ABC,商事", "組織", "他,x", "", "PER,", "人物,田中太郎"]
    (tmp_path / "a.txt").write_text("\n".join(lines), "utf-8")
    got = gazetteer.read(spark, str(tmp_path / "a.txt")).collect()
    assert sorted(map(tuple, got)) == sorted(entities.custom_names(lines)) == [("人物", "田中太郎"), ("組織", "ABC,商事")]
