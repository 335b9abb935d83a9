"""The band of perplexities."""

from inkveil.llm import quality


def test_the_band_follows_the_language(spark):
    """Ranges far below a twentieth count as they are, and equal documents stay."""
    near = [("en", 2.0 + 0.001 * i) for i in range(41)] + [("en", 1.85)] + [("fr", 3.1234)] * 9
    stats = spark.createDataFrame([(*r, False) for r in near], "lang string, log_perplexity double, base_failed boolean")
    band = {r["lang"]: (r["low"], r["high"]) for r in quality.bands(stats).collect()}
    assert 1.85 < band["en"][0] < 2.0 and 2.04 < band["en"][1] < 2.1
    assert band["fr"][0] <= 3.1234 <= band["fr"][1]
