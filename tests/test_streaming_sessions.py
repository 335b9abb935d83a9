"""Streams with labels in the state store, over restarts, against the plain version."""

import datetime
import time

import plain
import pytest
from test_long_texts import sentences

from inkveil.streaming import sessions

TODAY = datetime.date(2026, 3, 1)
SCHEMA = "id long, person string, text string, score double"


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, sessions.PROVIDER)
    yield
    spark.conf.unset(key)


def _run(spark, folder, **options):
    """One start of the stream over what is there, until nothing is left."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = sessions.mask_sessions(stream, "id", session=stream["person"], today=TODAY, **options)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(200) and query.exception() is None
    return spark.read.parquet(f"{folder}/out").collect()


def test_labels_go_on_over_batches_and_restarts(spark, tmp_path, store):
    texts = sentences(45, 12)
    rows = [(i, ["a", "b", None][i % 3], " ".join(texts[3 * i : 3 * i + 3]) if i != 4 else None, 0.5) for i in range(15)]
    plain_sessions, expected = {}, {}
    for i, person, text, _ in rows:
        own = plain_sessions.setdefault(person or "", plain.Session())
        expected[i] = None if text is None else own.mask(text, TODAY)
    for k in range(3):  # each time the stream is started anew
        spark.createDataFrame(rows[5 * k : 5 * k + 5], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        got = _run(spark, tmp_path)
        assert {r["id"]: r["masked"] for r in got} == {i: expected[i] for i in range(5 * k + 5)}
    for r in got:
        own = plain_sessions[r["person"] or ""]
        assert all(own.labels[m["category"]][m["md5"]] == m["label"] and plain.md5_8(m["original"]) == m["md5"] for m in r["mapping"])
        assert r["text"] == rows[r["id"]][2] and r["score"] == 0.5


def test_idle_sessions_end(spark, tmp_path, store):
    """A stream that is never done, as it waits for sessions to end."""
    texts = ["03-1111-0001", "03-2222-0002"]
    found = {}
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    out = sessions.mask_sessions(stream, "id", session=stream["person"], idle_ms=1, only_rules=True)
    query = out.writeStream.foreachBatch(lambda df, n: found.update({r["id"]: r["masked"] for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        for k, text in enumerate(texts):
            spark.createDataFrame([(k, "a", text, 0.5)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            until = time.time() + 100
            while k not in found and time.time() < until and query.exception() is None:
                time.sleep(0.5)
    finally:
        query.stop()
    assert found == {0: "【電話A】", 1: "【電話A】"}


def test_the_store_must_be_set(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        sessions.mask_sessions(spark.createDataFrame([(1, "a")], "id long, text string"), "id")
