"""Mapping files: four fields in a line, tab-separated; backslash, tab, newline and carriage return in a text are escaped."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "#カテゴリ\t元テキスト\tMD5\tラベル"
_ESCAPES = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}
SCHEMA = "session string, category string, original string, md5 string, label string"


def escaped(text: Column) -> Column:
    for char, mark in _ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(mark))
    return text


def unescape(text: str) -> str:
    """The inverse of escaped, in one pass, so that a backslash before a t stays one."""
    back = {v: k for k, v in _ESCAPES.items()}
    return re.sub(r"\\[\\tnr]", lambda m: back[m[0]], text)


def load(spark: SparkSession, path: str, session: str = "") -> DataFrame:
    """A mapping file's rows; comments, blank lines and lines of another width are passed over."""
    lines = Path(path).read_text(encoding="utf-8").split("\n")
    rows = [line.split("\t") for line in lines if line and not line.startswith("#")]
    return spark.createDataFrame([(session, r[0], unescape(r[1]), r[2], r[3]) for r in rows if len(r) == 4], SCHEMA)


def lines(mapping: DataFrame) -> DataFrame:
    """line, and the columns by which lines are in order, of each row of a mapping."""
    return mapping.select(F.concat_ws("\t", "category", escaped(F.col("original")), "md5", "label").alias("line"), "category", F.length("label").alias("width"), "label", "original")


def to_bytes(mapping: DataFrame) -> bytes:
    """A session's mapping as the content of its file."""
    rows = lines(mapping).orderBy("category", "width", "label", "original").select("line")
    return "".join(f"{line}\n" for line in [HEADER, *(row["line"] for row in rows.toLocalIterator())]).encode()


def save(mapping: DataFrame, path: str) -> None:
    """Writes beside the file and then puts it in its place; what was there is kept as .bak."""
    target = Path(path)
    if target.exists():
        shutil.copy2(target, f"{target}.bak")
    rows = lines(mapping).orderBy("category", "width", "label", "original").select("line")
    handle, name = tempfile.mkstemp(dir=target.parent, suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            file.write(HEADER + "\n")
            file.writelines(f"{row['line']}\n" for row in rows.toLocalIterator())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def load_names(path: str) -> list[tuple[str, str]]:
    """A file of custom names."""
    from inkveil.operators.entities import custom_names

    return custom_names(Path(path).read_text(encoding="utf-8").splitlines())
