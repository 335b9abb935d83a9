"""Languages by one table and by several: the same predictions."""

from inkveil.llm import langid


def _rows(frame):
    return sorted(((r["doc_id"], r["text"], r["__lang_pred"], round(r["__score"], 9), r["__bits"] and round(r["__bits"], 9)) for r in frame.collect()), key=repr)


def test_tables_of_few_languages_say_the_same(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(spark.createDataFrame([(None, None, "en"), (7, "", None), (None, "123 !", "fr"), (None, "the text", None)], docs.schema))
    one, several = langid.learn(docs), langid.learn(docs, table_languages=2)
    assert isinstance(several, list) and len(several) > 1
    found = _rows(langid.identify(docs, one, ("doc_id", "text")))
    assert found == _rows(langid.identify(docs, several, ("doc_id", "text"))) and len(found) == docs.count()


def test_more_labels_than_a_table_takes(spark):
    rows = [(n, "".join(chr(97 + (n * 7 + k * k) % 26) for k in range(60)), f"l{n:03}") for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, langid.learn(docs)).collect()
    assert len(found) == 400 and all(r["__lang_pred"].startswith("l") and 0 <= r["__score"] <= 1 for r in found)
