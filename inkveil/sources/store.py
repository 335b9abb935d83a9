"""A mapping as a table of versions that runs share: buckets by value, additions as small files, and a manifest that makes a version whole.

A version is a manifest, which lists the folders of each bucket. A run reads a version, adds what it labelled to the buckets concerned, and creates the manifest of
the next number, which can be done only once: of two runs that started from one version the later one is refused, so that no label is given
twice. A run that dies leaves no version. The version before the last one stays readable. Where files can't be created exclusively (some object stores) writers must be
kept apart by other means.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mappings import SCHEMA

BUCKETS = 64
#: Folders of a bucket beyond which they become one.
MOST_FOLDERS = 8


class StaleWriter(Exception):
    """Another run has written since the version that this one started from: it is to be read, and the work done again."""


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("session", "category", "md5"), F.lit(buckets)).cast("int")


@dataclass
class MappingStore:
    """path: a folder of any file system that Spark can read and write."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _file(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self) -> list[int]:
        """The numbers of the versions that can be read, in order."""
        fs, place = self._file("manifests")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(place)) if fs.exists(place) else []

    def version(self) -> int:
        """The last version's number; 0 if nothing was written."""
        return max(self.versions(), default=0)

    def _folders(self, version: int) -> dict[int, list[str]]:
        if not version:
            return {}
        fs, place = self._file(f"manifests/{version:010d}")
        file = fs.open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()
        said = json.loads(text)
        if said["buckets"] != self.buckets:
            raise ValueError(f"the store has {said['buckets']} buckets")
        return {int(k): v for k, v in said["folders"].items()}

    def _rows(self, folders: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.path}/data/{name}/bucket={k}" for k, names in folders.items() for name in names]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def read(self, version: int | None = None) -> DataFrame:
        """session, category, original, md5 and label of a version (the last one)."""
        return self._rows(self._folders(self.version() if version is None else version))

    def add(self, rows: DataFrame, since: int) -> int:
        """The number of the version that has the rows of version since and those of rows whose (session, category, original) it lacks.

        rows may hold what the version has already, as the mapping that masking returns does. Only buckets that get rows are looked into; what is written are the new rows, and
        buckets of too many folders as a whole. Raises StaleWriter if since isn't the last version (any more).
        """
        if since != self.version():
            raise StaleWriter(f"{since} is not the last version")
        folders, name = self._folders(since), uuid.uuid4().hex
        keys = ["session", "category", "original"]
        fresh = rows.select("session", "category", "original", "md5", "label").dropDuplicates(keys).join(self._rows(folders).select(keys), keys, "left_anti")
        self._write(fresh, name)
        fs, place = self._file(f"data/{name}")
        touched = sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(place) if x.isDirectory() and "=" in x.getPath().getName())
        after = {**folders, **{k: [*folders.get(k, []), name] for k in touched}}
        long = {k: v for k, v in after.items() if len(v) > MOST_FOLDERS}
        if long:
            one = uuid.uuid4().hex
            self._write(self._rows(long), one)
            after |= {k: [one] for k in long}
        self._commit(since + 1, after)
        self._forget(since - 1, folders, after)
        return since + 1

    def _write(self, rows: DataFrame, name: str) -> None:
        bucketed = rows.withColumn("bucket", _bucket(self.buckets))
        bucketed.repartition(min(self.buckets, 4 * self.spark.sparkContext.defaultParallelism), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")

    def _commit(self, version: int, folders: dict[int, list[str]]) -> None:
        fs, place = self._file(f"manifests/{version:010d}")
        try:
            file = fs.create(place, False)  # fails if it is there
        except Exception as e:
            if fs.exists(place):
                raise StaleWriter(f"version {version} was written meanwhile") from e
            raise
        try:
            file.write(bytearray(json.dumps({"buckets": self.buckets, "folders": folders}).encode()))
        finally:
            file.close()

    def _forget(self, version: int, before: dict[int, list[str]], after: dict[int, list[str]]) -> None:
        """Deletes a version and the folders that only it has."""
        if version < 1:
            return
        used = {x for v in (*before.values(), *after.values()) for x in v}
        old = {x for v in self._folders(version).values() for x in v}
        for name in [f"manifests/{version:010d}", *(f"data/{x}" for x in old - used)]:
            fs, place = self._file(name)
            fs.delete(place, True)
