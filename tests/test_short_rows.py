"""Rows of few events, and dates judged a batch at a time."""

import datetime

import pyarrow as pa

from inkveil.operators import dates, masking

TODAY = datetime.date(2026, 1, 1)


def test_labels_of_few_and_of_many_events_agree(spark, monkeypatch):
    texts = ["", None, "42歳", "03-1111-0001", "03-1111-0001と42歳と03-2222-0002と03-1111-0001と田中太郎部長と2025年4月1日と5円", "、".join(f"03-1111-000{i % 3}" for i in range(12))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def rows():
        return sorted(map(tuple, masking.mask_rows(masking.detect(df, today=TODAY)).select("id", "masked", "mapping").collect()))

    few = rows()
    assert few[4][1] == "【電話A】と40代と【電話B】と【電話A】と【人物A】部長と【日付A】と【金額A】円" and few[5][1] == "、".join(f"【電話{'ABC'[i % 3]}】" for i in range(12))
    monkeypatch.setattr(masking, "FEW_EVENTS", 0)
    assert rows() == few


def test_a_date_is_judged_once_over_batches():
    """Before, each batch judged its strings anew."""
    raws = pa.array([["2025/04/01", "99/99"], [], None, ["2025/04/01"]], pa.list_(pa.string()))
    before = dates.is_date.cache_info().misses
    for _ in range(3):
        assert dates._judged(raws, TODAY).to_pylist() == [[True, False], [], [], [True]]
    assert dates.is_date.cache_info().misses - before <= 2
