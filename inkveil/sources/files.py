"""Masking and restoring of files: read as binary, their units masked together, and put back file by file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import masking

from . import formats

_TYPES = {"text/plain": ".txt", "text/html": ".html", "image/svg+xml": ".svg", "image/png": ".png", "image/jpeg": ".jpg", "application/pdf": ".pdf"}


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, ext and content of files of known formats."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return spark.read.format("binaryFile").load(paths).select("path", ext.alias("ext"), "content").where(F.col("ext").isin(*formats.FORMATS, ".md"))


def units(files: DataFrame) -> DataFrame:
    """path, n and text of each unit."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                texts = formats.units(row.ext, bytes(row.content))
                yield pd.DataFrame({"path": row.path, "n": range(len(texts)), "text": texts}, columns=["path", "n", "text"])

    return files.mapInPandas(each, "path string, n int, text string")


def previews(files: DataFrame) -> DataFrame:
    """path and the text of each file's units, line by line."""
    ordered = F.array_sort(F.collect_list(F.struct("n", "text")))
    return units(files).groupBy("path").agg(ordered.alias("units")).select("path", F.array_join("units.text", "\n").alias("preview"))


def from_data_urls(df: DataFrame, column: str) -> DataFrame:
    """df with ext and content of the base64 data URLs in a column; both are null where it holds none."""
    kind = F.regexp_extract(column, r"^data:([\w.+/-]+);base64,", 1)
    ext = F.element_at(F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair]), kind)
    return df.withColumn("ext", F.when(kind != "", ext)).withColumn("content", F.when(kind != "", F.try_to_binary(F.substring_index(column, ",", -1), F.lit("base64"))))


def mask_files(files: DataFrame, mapping: DataFrame | None = None, **detection) -> tuple[DataFrame, DataFrame]:
    """(path, ext of what comes out, content; the mapping), all files in one session, in order of path."""
    each = units(files).withColumn("id", F.concat_ws("\0", "path", F.col("n").cast("string")))
    masked, labels = masking.mask(each, "id", order=["path", "n"], mapping=mapping, **detection)
    texts = masked.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "masked"))).alias("texts")).select("path", F.col("texts.masked").alias("texts"))

    def rebuild(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [formats.rebuilt(r.ext, bytes(r.content), [] if r.texts is None else list(r.texts)) for r in frame.itertuples()]
            yield pd.DataFrame({"path": frame["path"], "ext": [formats.FORMATS[e][1] for e in frame["ext"]], "content": out})

    return files.join(texts, "path", "left").mapInPandas(rebuild, "path string, ext string, content binary"), labels


def restore_files(files: DataFrame, mapping: DataFrame, plain: bool = False) -> DataFrame:
    """path, ext and content with tokens restored. Office files are restored member by member, each token alike; only the tokens that a file holds come to it."""
    office = F.col("ext").isin(".docx", ".pptx", ".xlsx")
    flat = files.where(~office).withColumn("text", F.decode("content", "UTF-8"))
    texts = masking.restore(flat, "path", mapping, text="text", plain=plain).select("path", "ext", F.encode("restored", "UTF-8").alias("content"))
    zipped = files.where(office)
    if zipped.isEmpty():
        return texts

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [sorted(formats.zip_tokens(bytes(c))) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "token": said}).explode("token").dropna()

    named = mapping.groupBy(masking.token(F.col("category"), F.col("label")).alias("token")).agg(F.max_by("original", F.struct("session", "md5", "original")).alias("original"))
    known = zipped.mapInPandas(tokens, "path string, token string").join(named, "token").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("known"))

    def rebuild(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            content = [formats.restored_zip(bytes(c), dict(k or {})) for c, k in zip(frame["content"], frame["known"], strict=True)]
            yield frame.assign(content=content)[["path", "ext", "content"]]

    return texts.unionByName(zipped.join(known, "path", "left").mapInPandas(rebuild, "path string, ext string, content binary"))
