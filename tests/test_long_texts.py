"""Masking against the plain version: crowded rows, long texts in parts, and all documents of the smallest scale."""

import datetime
import random
import re
import time

import plain
import pytest
from pyspark.sql import functions as F

from inkveil.functions import patterns, text
from inkveil.operators import masking

TODAY = datetime.date(2026, 3, 1)
FOLDER = "/root/testdata/sf0.001"


def sentences(n, seed=1):
    r = random.Random(seed)
    kinds = [
        lambda: f"03-{r.randint(1000, 1020)}-{r.randint(1000, 1009)}", lambda: f"令和{r.randint(1, 9)}年{r.randint(1, 13)}月{r.randint(1, 31)}日", lambda: f"due {r.randint(1, 12)}/{r.randint(1, 31)} and more of it", lambda: "𠮷田𠮷子さん、田中太郎部長",
        lambda: f"東京都千代田区丸の内{r.randint(1, 9)}-1-1丸の内ビル{r.randint(1, 9)}階", lambda: f"{r.randint(1, 99)}歳", lambda: "株式会社アルファ商事グループ", lambda: f"user{r.randint(1, 30)}@example.co.jp", lambda: f"{r.randint(1, 900)} kg of small things, May {r.randint(1, 31)}, 2025",
        lambda: "the quick brown fox; it jumps", lambda: f"特許第{r.randint(100, 130)}号", lambda: f"US Patent {r.randint(1, 9)},{r.randint(100, 120)}", lambda: f"型番：AB-{r.randint(1000, 1020)}", lambda: f"20{r.randint(10, 99)}-{r.randint(1, 12)}-{r.randint(1, 31)}", lambda: "大阪支店と京都支社",
    ]
    return [r.choice(kinds)() + r.choice(["。", "、", " ", "\n", "", " the end of that "]) for _ in range(n)]


def test_scans_and_choice_are_the_plain_ones(spark):
    """Sizes around the strides; overlaps in chains, nests and ties."""
    r = random.Random(3)
    rows = []
    for i, n in enumerate([0, 1, 2, 31, 33, 255, 256, 257, 513, 1500]):
        for width in (3, 40):
            spans = [(s := r.randint(0, 4 * n), s + r.randint(1, width)) for _ in range(n)]
            rows.append((2 * i + (width > 3), spans))
    df = spark.createDataFrame(rows, "id long, c array<struct<s:int,e:int>>")
    running = text.scanned(F.col("c"), F.lit(0), lambda at, x: (at + x["s"], at + x["e"]), "int")
    got = df.select("id", text.accepted(F.col("c"), "struct<s:int,e:int>").alias("kept"), running.alias("sums")).collect()
    for row, (_, spans) in zip(sorted(got), rows, strict=True):
        assert [tuple(x) for x in row["kept"]] == plain.disjoint(spans)
        at, sums = 0, []
        for s, e in spans:
            sums.append(at + e)
            at += s
        assert row["sums"] == sums


def test_ten_thousand_findings_in_a_row(spark):
    body = "".join(f"連絡先は03-{i % 7000 // 100:04d}-{i % 7000:04d}、担当" for i in range(10_000)) + "".join(sentences(1000))
    df = spark.createDataFrame([(0, body), (1, None), (2, "")], "id long, text string")
    masking.mask_rows(masking.detect(df.where("id = 1"), today=TODAY)).collect()
    began = time.time()
    rows = {r["id"]: r for r in masking.mask_rows(masking.detect(df, today=TODAY)).collect()}
    assert time.time() - began < 60
    session = plain.Session()
    assert rows[0]["masked"] == session.mask(body, TODAY) and rows[1]["masked"] is None and rows[2]["masked"] == ""
    assert {(m["category"], m["original"]): m["md5"] for m in rows[0]["mapping"]} == session.originals
    assert all(m["label"] == session.labels[m["category"]][m["md5"]] for m in rows[0]["mapping"])


@pytest.mark.parametrize("chars", [7, 60, 1000])
def test_parts_give_what_the_whole_text_gives(spark, chars):
    texts = ["".join(sentences(n, n)) for n in (1, 40, 400)] + ["no blank or stop" * 3, "あ" * 300, None, "", "同じ文。" * 50]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, other string").repartition(2)
    out, mapping = masking.mask(df, "id", part_chars=chars, today=TODAY)
    assert out.columns == ["id", "text", "other", "masked"]
    session = plain.Session()
    expected = {i: None if t is None else session.mask(t, TODAY) for i, t in enumerate(texts)}
    got = {r["id"]: r for r in out.collect()}
    assert {i: r["masked"] for i, r in got.items()} == expected
    assert {i: r["text"] for i, r in got.items()} == dict(enumerate(texts))
    assert {(r["category"], r["original"]): r["label"] for r in mapping.collect()} == {k: session.labels[k[0]][m] for k, m in session.originals.items()}


def test_parts_are_cut_at_sure_places(spark):
    body = "".join(sentences(300, 9))
    cut = patterns.cuts()
    got = spark.createDataFrame([(body,)], "t string").select(text.parts(F.col("t"), 50, cut)).first()[0]
    assert "".join(got) == body and len(got) > 20
    for end in range(1, len(got)):
        assert re.search(r"[。、]\Z", got[end - 1]) or (re.search(r"[a-z;!?]\Z", got[end - 1]) and re.match(r"\s[a-z]", got[end]))
    assert patterns.cuts(custom=("a、b",)) is None and "s[a-z]" not in patterns.cuts(custom=("small things",)) and patterns.cuts(rules=(patterns.Rule("x", "数値", ".*", "."),)) is None


def test_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    session = plain.Session()
    expected = {r["doc_id"]: None if r["text"] is None else session.mask(r["text"], TODAY) for r in docs.orderBy("doc_id").collect()}
    out, mapping = masking.mask(docs, "doc_id", today=TODAY, part_chars=3000)
    assert {r["doc_id"]: r["masked"] for r in out.collect()} == expected
    assert mapping.count() == len(session.originals) > 5
