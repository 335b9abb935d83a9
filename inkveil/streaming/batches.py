"""Masking of a stream: each micro-batch is masked with the labels of all before it, which a mapping table carries on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from inkveil.operators import masking


def _mapping(spark: SparkSession, path: str, before: int) -> DataFrame:
    """The mapping as the batches before this one left it: a batch that is run again starts from the same."""
    schema = f"batch long, session string, {masking.MAPPING}"
    try:
        table = spark.read.schema(schema).parquet(path)
        return table.where(F.col("batch") < before).drop("batch")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"session string, {masking.MAPPING}")


def mask_stream(stream: DataFrame, key: str, mapping_path: str, sink: Callable[[DataFrame, int], None], text: str = "text", **options) -> DataStreamWriter:
    """A writer of stream that gives sink each micro-batch with masked, and adds its new labels to the table at mapping_path."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = _mapping(spark, mapping_path, number)
        masked, mapping = masking.mask(batch, key, text, mapping=known, **options)
        new = mapping.join(known, ["session", "category", "original"], "left_anti").withColumn("batch", F.lit(number).cast("long"))
        sink(masked, number)
        # a folder for each batch: one that is run again replaces its own
        new.select("batch", "session", "category", "original", "md5", "label").drop("batch").write.mode("overwrite").parquet(f"{mapping_path}/batch={number}")

    return stream.writeStream.foreachBatch(each)
