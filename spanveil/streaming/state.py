"""Keyed state for streams: the last value seen, and the end of a pause.

Rows of one key within a micro-batch are gathered and ordered by time and sequence; rows that
arrive in a later batch come after them.  Where one key may have most of the rows, or order
is to follow event time, use ``ordered``, which keeps neither texts nor whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store, which also keeps it out of the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _keyed(rows: DataFrame, by: str) -> DataFrame:
    """Adds the state key: a text that is never null, so rows without owner share one."""
    return rows.withColumn("owner_key", F.to_json(F.struct(by)))


class LastValue(StatefulProcessor):
    """Keeps the digest of the last value and passes on rows that differ from it."""

    def __init__(self, time: str, tie: str, emit_first: bool):
        self.time, self.tie, self.emit_first = time, tie, emit_first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values([self.time, self.tie])
        before = batch["now_digest"].shift()
        known = self.last.exists()
        if known:
            before.iloc[0] = self.last.get()[0]
        changed = batch["now_digest"] != before
        if not known:
            changed.iloc[0] = self.emit_first
        self.last.update((batch["now_digest"].iloc[-1],))
        yield batch[changed].drop(columns=["now_digest", "owner_key"])

    def close(self) -> None:
        pass


def changed_rows(
    stream: DataFrame, by: str, time: str, tie: str, value: str, emit_first: bool = False
) -> DataFrame:
    """The streaming form of ``operators.changes.changes``."""
    rows = stream.filter(F.col(value).isNotNull()).withColumn("now_digest", F.sha2(value, 256))
    return _keyed(rows, by).groupBy("owner_key").transformWithStateInPandas(
        statefulProcessor=LastValue(time, tie, emit_first),
        outputStructType=stream.schema,
        outputMode="Append",
        timeMode="None",
    )


class PauseUntil(StatefulProcessor):
    """Keeps the end of the running pause and passes on alerts outside of it."""

    def __init__(self, time: str, seconds: int):
        self.time, self.seconds = time, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        # At the same instant a pause comes before an alert, so it hides it.
        batch = batch.sort_values(["at_micros", "is_pause"], ascending=[True, False], kind="stable")
        carried = float(self.until.get()[0]) if self.until.exists() else float("-inf")
        ends = (batch["at_micros"] + self.seconds * 1_000_000).where(batch["is_pause"])
        until = ends.cummax().ffill().fillna(carried).clip(lower=carried)
        last = until.iloc[-1]
        if last > float("-inf"):
            self.until.update((int(last),))
        shown = ~batch["is_pause"] & (batch["at_micros"] >= until)
        yield batch[shown].drop(columns=["at_micros", "is_pause", "owner_key"])

    def close(self) -> None:
        pass


def unpaused_rows(
    alerts: DataFrame, pauses: DataFrame, by: str, time: str, seconds: int
) -> DataFrame:
    """Alerts not raised during a pause; pauses are a control stream of (by, time)."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    shown = alerts.withColumn("at_micros", at).withColumn("is_pause", F.lit(False))
    control = pauses.select(by, time).withColumn("at_micros", at).withColumn("is_pause", F.lit(True))
    both = shown.unionByName(control, allowMissingColumns=True)
    return _keyed(both, by).groupBy("owner_key").transformWithStateInPandas(
        statefulProcessor=PauseUntil(time, seconds),
        outputStructType=StructType(alerts.schema.fields),
        outputMode="Append",
        timeMode="None",
    )
