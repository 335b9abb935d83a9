"""Functions that SQL can call by name."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, result.
_FUNCTIONS = (
    ("md5_8", "original STRING", "upper(left(md5(original), 8))"),
    # the index in bijective base 26, letter by letter from the right: place k turns at 1 + 26 + ... + 26^k
    ("label_of", "place BIGINT", "array_join(reverse(transform(filter(sequence(0, 7), k -> place + 1 >= (power(26, k + 1) - 1) / 25), k -> char(65 + cast(floor((place + 1 - (power(26, k + 1) - 1) / 25) / power(26, k)) % 26 AS INT)))), '')"),
    ("mask_token", "category STRING, label STRING", "concat('【', category, label, '】')"),
)


def register(spark: SparkSession) -> None:
    """md5_8(text), label_of(index) and mask_token(category, label) for the session's SQL."""
    for name, parameters, body in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS STRING RETURN {body}")
