"""A training-data pipeline over the table of documents, in five stages.

Quality rules reject documents; language identification rejects what no language explains; of each group of near
duplicates one document stays; passages that earlier documents have are removed; what is left is packed into windows.
Each stage works on all that its predecessor kept, which is written as Parquet and read again.

A row without doc_id leaves in the first stage, as nothing could refer to it; rows that share a doc_id leave all but one
in the third. A null text is empty and leaves in the first. Further columns of the table are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import jaccard, langid, packing, quality, suffixes
from inkveil.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and their language's perplexity band keep."""
    named = docs.where("doc_id is not null").withColumn("__row", F.xxhash64("doc_id", "text", "lang"))  # rows of one doc_id are judged by themselves
    kept = quality.quality(named, "__row").where("kept").select("doc_id", "__row")
    return named.join(kept, ["doc_id", "__row"], "left_semi").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text has a language: letters, and no more entropy than one of the languages leaves."""
    found = langid.identify(docs, langid.learn(docs), tuple(docs.columns))
    return found.where((F.col("__lang_pred") != "und") & (F.col("__bits") <= langid.MAX_BITS)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least doc_id; of rows that share it, the one of least text (then of least other columns, as JSON)."""
    groups = jaccard.near_duplicates(docs)
    kept = groups.where("doc_id = component_id").select("doc_id")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.struct("text", *([F.to_json(F.struct(*others))] if others else [])))
    return docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes that windows of documents of smaller doc_id cover; a character of which a part goes, goes."""
    cut = suffixes.without_passages(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in windows."""
    return packing.packed_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", pack),
]
#: SQL can't say the model's verdicts, the automata or the tokenizer; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
