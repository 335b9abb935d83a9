"""Masking of a stream with the labels of each session in the state store: a batch costs what its own rows cost, however many came before.

Detection and rewriting are projections of the stream; between them one stateful operator, keyed by session, gives each value its label: a map
from (category, md5) to the label's place and a count for each category, of which only the entries that a batch needs are read. Rows of a session and a batch
come in the order of a column. A session that had no rows for a while can be ended, which frees its state; its values then take labels from A on.

State and progress are in the checkpoint: a batch that is run again starts from the state before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from inkveil.functions.text import PIECE, label, md5_8, spliced
from inkveil.operators import masking

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SAID = f"struct<pieces:array<{PIECE}>,events:array<struct<cat:string,raw:string,md5:string>>>"


class SessionLabels(StatefulProcessor):
    """Gives rows with keys (array of category and md5, or null) the places of their labels; rows in the order of the columns at and said."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("places", "key string", "place long")
        self.counts = handle.getMapState("counts", "category string", "n long")
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.idle_ms is not None:
            self._touch(timerValues.getCurrentProcessingTimeInMs())
        batch = pd.concat(list(rows)).sort_values(["at", "said"], kind="stable")
        places: dict[str, int] = {}
        counts: dict[str, int] = {}
        out = []
        for keys in batch["keys"]:
            own = []
            for k in keys:
                if k is not None and k not in places:
                    category = k.split("\0")[0]
                    held = self.known.getValue((k,))
                    if held is None:
                        if category not in counts:
                            before = self.counts.getValue((category,))
                            counts[category] = 0 if before is None else before[0]
                        held = (counts[category],)
                        counts[category] += 1
                        self.known.updateValue((k,), held)
                    places[k] = held[0]
                own.append(None if k is None else places[k])
            out.append(own)
        for category, n in counts.items():
            self.counts.updateValue((category,), (n,))
        batch["places"] = out
        yield batch.drop(columns=["keys", "at", "session"])

    def _touch(self, now: int) -> None:
        """Ends the session if it was idle for too long, and sees to its end if it will be."""
        last = self.seen.get()
        if last is not None and now - last[0] > self.idle_ms:
            self._clear()
        self.seen.update((now,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(now + self.idle_ms + 1)

    def _clear(self) -> None:
        self.known.clear()
        self.counts.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._clear()
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def mask_sessions(stream: DataFrame, order: str, session: Column | None = None, text: str = "text", idle_ms: int | None = None, **detection) -> DataFrame:
    """stream with masked and mapping (array<struct<category, original, md5, label>>: the row's values), labels going on from batch to batch.

    order: the column by which rows of a session come in a batch; session: whose labels a row shares (default: one for all; null: that of ""). idle_ms: a session without rows for
    longer ends. A null text stays null. The session's state store must be that of RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    source = stream.withColumn("__session", F.coalesce(session, F.lit("")) if session is not None else F.lit("")).withColumn("__at", F.col(order))
    found = masking.detect(source, text, **detection)
    events = F.transform("__events", lambda e: F.struct(e["cat"].alias("cat"), e["raw"].alias("raw"), md5_8(e["raw"]).alias("md5")))
    found = found.withColumn("__all", events).withColumn("__said", F.to_json(F.struct(F.col("__pieces").alias("pieces"), F.col("__all").alias("events"))))
    keys = F.transform("__all", lambda e: F.when(e["cat"].isNotNull(), F.concat(e["cat"], F.lit("\0"), e["md5"])))
    # the stateful step takes no names that begin with an underscore: columns are numbered there
    numbered = [F.col(c).alias(f"c{i}") for i, c in enumerate(stream.columns)]
    found = found.select(*numbered, F.col("__session").alias("session"), F.col("__at").alias("at"), F.col("__said").alias("said"), keys.alias("keys"))
    schema = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(stream.schema.fields)), *StructType.fromDDL("said string, places array<bigint>").fields])
    named = found.groupBy("session").transformWithStateInPandas(SessionLabels(idle_ms), schema, "Append", "None" if idle_ms is None else "ProcessingTime")
    named = named.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(stream.columns)), F.from_json("said", _SAID).alias("__said"), F.col("places").alias("__places"))
    name = lambda ev: label(F.element_at("__places", ev + 1))
    shown = F.transform("__said.pieces", lambda p: masking._replacement(p, name(p["ev"])))
    mapping = F.transform(F.filter(F.transform("__said.events", lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: x["e"]["cat"].isNotNull()), lambda x: F.struct(x["e"]["cat"].alias("category"), x["e"]["raw"].alias("original"), x["e"]["md5"].alias("md5"), name(x["i"]).alias("label")))
    masked = F.when(F.col(text).isNotNull(), spliced(F.col(text), shown))
    return named.select(*stream.columns, masked.alias("masked"), F.array_distinct(mapping).alias("mapping"))
