"""Masked texts, labels and round trips, with exact expectations."""

import datetime

import pytest

from inkveil.operators import masking

TODAY = datetime.date(2026, 3, 1)
CASES = [
    ("2025年4月1日", "【日付A】"), ("令和7年4月1日", "【日付A】"), ("R7.4.1", "【日付A】"), ("2025/04/01", "【日付A】"), ("2025-04-01", "【日付A】"), ("2025.04.01", "【日付A】"), ("20250401", "【日付A】"),
    ("4月1日に開催", "【日付A】に開催"), ("April 1, 2025", "【日付A】"), ("２０２５年４月１日", "【日付A】"), ("二〇二五年四月一日", "【日付A】"), ("03-1234-5678", "【電話A】"), ("3,000万円", "【金額A】万円"),
    ("150億円", "【金額A】億円"), ("重量2.5kg", "重量【数値A】kg"), ("温度85℃", "温度【数値A】℃"), ("納期45日", "納期【数値A】日"), ("42歳", "40代"), ("38歳", "30代"), ("25歳", "20代"), ("65歳", "60代"), ("４２歳", "40代"),
    ("東京都千代田区丸の内1-1-1", "東京都【住所A】"), ("〒160-0023 新宿区西新宿2-8-1", "〒【住所A】 【住所B】"), ("東京支社との会議", "【住所A】支社との会議"), ("大阪府の規制によると", "大阪府【住所A】"),
    ("090-9876-5432", "【電話A】"), ("tanaka@example.co.jp", "【メールA】"), ("@tanaka_taro", "【SNSA】"), ("github.com/tanaka", "【SNSA】"), ("型番：ABC-12345-XZ", "【型番A】"), ("シリアル：SN20251234", "【シリアルA】"),
    ("特許第6123456号", "特許第【特許A】号"), ("US Patent 9,123,456", "US Patent 【特許A】"), ("田中太郎部長", "【人物A】部長"), ("鈴木花子さん", "【人物A】さん"), ("ABC株式会社", "【組織A】"), ("株式会社XYZテクノロジー", "【組織A】"),
    ("03-1111-0001と03-2222-0002と03-3333-0003", "【電話A】と【電話B】と【電話C】"), ("平成30年4月1日と田中太郎部長", "【日付A】と【人物B】部長"), ("東京都千代田区丸の内で2025年4月1日", "東京都千代田区丸の内で【日付A】"),
    ("20241015", "20241015"), ("3億5000万円", "3億【金額A】万円"), ("¥3,000", "¥3,000"), ("100歳", "100歳"), ("5歳", "0代"), ("京都支社", "京都支社"), ("北海道支社", "北海道【住所A】"), ("US, we agreed", "US【特許A】 we agreed"),
    ("@user#1234", "【SNSA】#1234"), ("5 games", "【数値A】 games"), ("", ""), (None, None), ("𠮷田 42歳 𠮷", "𠮷田 40代 𠮷"), ("〒231-0001 神奈川県横浜市中区新港1-1", "〒【住所A】"),
]


@pytest.fixture(scope="module")
def masked(spark):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)]
    found = masking.detect(spark.createDataFrame(rows, "id long, text string"), today=TODAY)
    return {r["id"]: r for r in masking.mask_rows(found).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_masked_text(masked, i):
    assert masked[i]["masked"] == CASES[i][1]


def test_shared_session_and_round_trip(spark):
    texts = ["田中太郎部長、03-1234-5678、tanaka@example.co.jp", "2025年4月1日の会議", "鈴木花子さんと田中太郎部長", "東京都千代田区丸の内1-1-1", "〒231-0001 神奈川県横浜市中区新港1-1", "東京支社との会議", "何もない", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out, mapping = masking.mask(df, "id", today=TODAY)
    rows = {r["id"]: r["masked"] for r in out.collect()}
    assert rows[0] == "【人物A】部長、【電話A】、【メールA】" and rows[2] == "【人物B】さんと【人物A】部長" and rows[6] == "何もない" and rows[7] is None
    back = {r["id"]: r["restored"] for r in masking.restore(out, "id", mapping).collect()}
    assert back == dict(enumerate(texts))
    plain = {r["id"]: r["restored"] for r in masking.restore(out, "id", mapping, plain=True).collect()}
    assert plain[3] == "東京都東京都千代田区丸の内1-1-1"


def test_labels_go_on_from_an_earlier_mapping(spark):
    one = spark.createDataFrame([(0, "田中太郎部長と鈴木花子さん")], "id long, text string")
    _, mapping = masking.mask(one, "id", today=TODAY)
    rows = mapping.collect()
    two = spark.createDataFrame([(0, "佐藤次郎さんと鈴木花子さんと田中太郎部長")], "id long, text string")
    out, later = masking.mask(two, "id", mapping=spark.createDataFrame(rows, mapping.schema), today=TODAY)
    assert out.first()["masked"] == "【人物C】さんと【人物B】さんと【人物A】部長"
    assert later.count() == 3


def test_custom_names_come_first(spark):
    df = spark.createDataFrame([(0, "アルファと社内ベータ")], "id long, text string")
    found = masking.mask_rows(masking.detect(df, custom=[("人物", "アルファ"), ("組織", "ベータ")], today=TODAY)).first()
    assert found["masked"] == "【人物A】と社内【組織A】"
    assert [tuple(m)[:2] for m in found["mapping"]] == [("人物", "アルファ"), ("組織", "ベータ")]


def test_null_and_repeated_keys(spark):
    rows = [(None, "連絡先はtaro@example.co.jpです"), (None, "連絡先はhanako@example.co.jpです"), (1, "連絡先はtaro@example.co.jpです"), (1, "連絡先はjiro@example.co.jpです"), (1, "連絡先はtaro@example.co.jpです"), (2, None), (None, "なし")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    out, mapping = masking.mask(docs, key="id")
    said = out.select("id", "text", "masked").collect()
    assert sorted(((r[0], r[1]) for r in said), key=repr) == sorted(rows, key=repr)
    assert all("@" not in (r["masked"] or "") and (r["masked"] is None) == (r["text"] is None) for r in said)
    assert mapping.count() == 3 and len({r["masked"] for r in said if r["text"] and "@" in r["text"]}) == 3
    back = masking.restore(out, "id", mapping).collect()
    assert len(back) == len(rows) and all(r["restored"] == r["text"] for r in back)


def test_office_files_are_restored_as_xml(spark):
    import io
    import zipfile

    from inkveil.sources import formats

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr("word/document.xml", "<a b='【組織A】'>【組織A】と【人物Z】</a>")
        file.writestr("media/x.png", b"\xff\xfe")
    assert formats.zip_tokens(out.getvalue()) == {"【組織A】", "【人物Z】"}
    with zipfile.ZipFile(io.BytesIO(formats.restored_zip(out.getvalue(), {"【組織A】": "R&D<株>"}))) as file:
        assert file.read("word/document.xml").decode() == "<a b='R&amp;D&lt;株&gt;'>R&amp;D&lt;株&gt;と【人物Z】</a>" and file.read("media/x.png") == b"\xff\xfe"
