"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that sets none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="inkveil-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a Parquet table and read from there; a lost executor costs no more than a reread."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._inkveil_path = path
    return out


#: Rows of a task at most: short ones, and those of tables of texts.
ROWS, LONG_ROWS = 50_000, 4_096


def spread(scan: DataFrame, rows: int = ROWS) -> DataFrame:
    """A scan of few splits, dealt out over all cores and into tasks of about so many rows; one that has so many splits as it is. For costly work on each row: a split holds the more rows the better they are compressed."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()
    wanted = max(cores, -(-scan.count() // rows))  # by the files' footers
    return scan.repartition(max(4 * cores, wanted)) if splits < wanted else scan


def dropped(*tables: DataFrame) -> None:
    """Deletes what written() wrote for these, once nothing that is still to be computed reads them; other frames stay as they are."""
    for df in tables:
        if path := getattr(df, "_inkveil_path", None):
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
