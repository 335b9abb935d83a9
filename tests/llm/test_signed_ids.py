"""doc_ids that are signed hashes."""

import helpers

from inkveil.llm import fmindex, suffixes


def _texts():
    said = [(r[0], r[1]) for r in helpers.rows()[:100] if r[0] is not None]
    return [(-d - 1 if d % 2 else (-(2**63) if d == 4 else d), t) for d, t in said]


def test_windows_and_passages_of_negative_ids(spark, tmp_path):
    path, texts = str(tmp_path), _texts()
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    expected = helpers.brute_windows(texts)
    assert sum(r[2] > 0 for r in expected if r[0] < 0) > 5
    assert sorted(tuple(r) for r in fmindex.op7_fmindex(spark, path).collect()) == sorted(expected)
    assert sorted(tuple(r) for r in suffixes.op8_suffixes(spark, path).collect()) == sorted(helpers.brute_passages(texts))
