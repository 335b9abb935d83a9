"""The mapping store: versions, refusal of stale writers, additions, and labels over runs."""

import datetime

import plain
import pytest

from inkveil.operators import masking
from inkveil.sources import store
from inkveil.sources.mappings import SCHEMA

TODAY = datetime.date(2026, 3, 1)


def _rows(numbers, session="s"):
    return [(session, "電話", f"03-{i}", f"{i:08X}", f"L{i}") for i in numbers]


def _read(s, version=None):
    return sorted(map(tuple, s.read(version).collect()))


def test_versions(spark, tmp_path):
    s = store.MappingStore(spark, str(tmp_path / "m"), buckets=4)
    assert s.version() == 0 and s.read().count() == 0
    table = lambda n: spark.createDataFrame(_rows(n), SCHEMA)
    assert s.add(table(range(20)), 0) == 1 and s.add(table(range(15, 30)), 1) == 2
    assert _read(s) == sorted(_rows(range(30))) and _read(s, 1) == sorted(_rows(range(20)))
    with pytest.raises(store.StaleWriter):
        s.add(table([99]), 1)
    assert s.add(table([5]), 2) == 3 and s.versions() == [2, 3] and _read(s) == sorted(_rows(range(30)))
    with pytest.raises(ValueError, match="buckets"):
        store.MappingStore(spark, str(tmp_path / "m"), buckets=8).read()


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    s = store.MappingStore(spark, str(tmp_path / "m"), buckets=2)
    commit = s._commit

    def late(version, folders):  # another one commits just before
        monkeypatch.undo()
        store.MappingStore(spark, s.path, 2).add(spark.createDataFrame(_rows([1]), SCHEMA), 0)
        commit(version, folders)

    monkeypatch.setattr(s, "_commit", late)
    with pytest.raises(store.StaleWriter):
        s.add(spark.createDataFrame(_rows([2]), SCHEMA), 0)
    assert _read(s) == _rows([1]) and s.version() == 1


def test_small_additions_write_little_and_folders_stay_few(spark, tmp_path):
    s = store.MappingStore(spark, str(tmp_path / "m"), buckets=8)
    s.add(spark.createDataFrame(_rows(range(300)), SCHEMA), 0)
    before = s._folders(1)
    s.add(spark.createDataFrame(_rows([1000]), SCHEMA), 1)
    after = s._folders(2)
    assert sum(after[k] != before[k] for k in before) == 1
    for i in range(10):
        s.add(spark.createDataFrame(_rows([1000 + i]), SCHEMA), s.version())
    assert max(len(v) for v in s._folders(s.version()).values()) <= store.MOST_FOLDERS
    assert _read(s) == sorted(_rows([*range(300), *range(1000, 1010)]))


def test_labels_over_runs(spark, tmp_path):
    s, session = store.MappingStore(spark, str(tmp_path / "m"), buckets=4), plain.Session()
    for texts in (["03-1111-0001と03-2222-0002", "令和7年4月1日"], ["03-3333-0003と03-1111-0001、42歳", None], []):
        since = s.version()
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        out, mapping = masking.mask(df, "id", mapping=s.read(since), today=TODAY)
        assert {r["id"]: r["masked"] for r in out.collect()} == {i: t and session.mask(t, TODAY) for i, t in enumerate(texts)}
        s.add(mapping, since)
    assert {(r["category"], r["original"]): r["label"] for r in s.read().collect()} == {k: session.labels[k[0]][m] for k, m in session.originals.items()}
