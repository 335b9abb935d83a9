"""Joins to a table that has each key once, where a few keys may take a large part of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many keys are taken for frequent, out of so many that the sketch follows: a key of more than two in TOP rows is among them, whatever the sketch's error.
TOP, FOLLOWED = 256, 8192


def _number(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def frequent(rows: DataFrame, keys: list[str]) -> list[int]:
    """The numbers of the most frequent keys without nulls, by a mergeable sketch of fixed size: no shuffle by key. Keys of one number are frequent together, which changes their way and not the result."""
    found = rows.dropna(subset=keys).select(_number(keys).alias("n")).agg(F.expr(f"approx_top_k(n, {TOP}, {FOLLOWED})").alias("top")).first()
    return [x["item"] for x in found["top"] or []]


def join_unique(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """rows joined to table (each key once) by keys; how: left or inner.

    What belongs to frequent keys, at most TOP rows of the table (and those whose numbers are equal by chance), is sent to all tasks;
    their rows stay where they are, and so do rows with a null in a key, which match nothing. All others are shuffled by key, where none can take more than
    two in TOP of all rows. rows are read three times.
    """
    hot = frequent(rows, keys)
    known = _number(keys).isin(hot) if hot else F.lit(False)
    stays = reduce(or_, (F.col(k).isNull() for k in keys)) | known
    near = rows.where(stays).join(F.broadcast(table.where(known)), keys, how)
    return near.unionByName(rows.where(~stays).join(table, keys, how))
