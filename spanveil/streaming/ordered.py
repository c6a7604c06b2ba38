"""Change detection on streams in the order of event time, whatever the size of an owner.

Only keys, times and digests enter the state.  Rows are held by owner and time slice until
the watermark has passed the slice, so a worker holds one slice of one owner at a time and
rows that arrive late, but within the delay, take their place.  A closed slice hands on its
own changes and what its ends look like; a second state compares each slice's first value
with the last one of the owner's slice before.  Slices are an aggregation of the engine;
only the second state calls Python, for a fixed number of groups of owners.  Texts are joined
back by key afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanveil.functions.arrays import let


SHARDS = 256


def slice_changes(held: Column) -> Column:
    """``at, tie, digest, last, is_first`` of the changes in a slice's rows, its first row included."""
    def rows(ordered: Column) -> Column:
        placed = F.transform(ordered, lambda row, i: F.struct(
            row["at"].alias("at"), row["tie"].alias("tie"), row["digest"].alias("digest"),
            F.get(ordered, F.size(ordered) - 1)["digest"].alias("last"), (i == 0).alias("is_first"),
            F.coalesce(F.get(ordered, i - 1)["digest"] != row["digest"], F.lit(True)).alias("changed"),
        ))
        return F.filter(placed, lambda row: row["changed"])

    return let(F.array_sort(held), rows)


class OwnerChanges(StatefulProcessor):
    """Keeps the last digest of each owner's closed slices; one row per slice is compared with it.

    Owners share a group, as a group costs several calls however few rows it has.
    """

    def __init__(self, emit_first: bool):
        self.emit_first = emit_first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "owner_key string", "digest binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns, heads = ["owner_key", "at", "tie"], []
        for frame in rows:
            heads.append(frame[frame["is_first"]])
            yield frame.loc[~frame["is_first"], columns]
        ordered = pd.concat(heads).sort_values(["owner_key", "slice"])
        changed, owner, before = [], None, None
        for name, digest, last in zip(ordered["owner_key"], ordered["digest"], ordered["last"]):
            if name != owner:
                if owner is not None:
                    self.last.updateValue((owner,), (before,))
                known = self.last.getValue((name,))
                owner, before = name, None if known is None else bytes(known[0])
            changed.append(self.emit_first if before is None else bytes(digest) != before)
            before = bytes(last)
        if owner is not None:
            self.last.updateValue((owner,), (before,))
        yield ordered.loc[changed, columns]

    def close(self) -> None:
        pass


def changed_keys(
    stream: DataFrame, by: str, time: str, tie: str, value: str,
    delay: str = "10 minutes", step_seconds: int = 60, emit_first: bool = False,
) -> DataFrame:
    """``by, time, tie`` of the rows whose ``value`` differs from the owner's row before.

    The streaming form of ``operators.changes.changes`` with its order: time, then ``tie``.
    A row comes out when the watermark (``delay`` behind the latest time seen) has passed
    its slice of ``step_seconds``; rows later than that are left out.  Null values and null
    times are skipped, rows without owner count as one owner.  An owner's rows of one slice
    must fit a worker: choose the step by the busiest owner.
    """
    tie_type = dict(stream.dtypes)[tie]
    owner_type = dict(stream.dtypes)[by]
    rows = (
        stream.select(F.to_json(F.struct(F.col(by).alias("by"))).alias("owner_key"),
                      F.col(time).cast("timestamp").alias("event_time"), F.col(tie).alias("tie"),
                      F.unhex(F.sha2(F.col(value).cast("string"), 256)).alias("digest"))
        .filter("digest is not null and event_time is not null")
        .withWatermark("event_time", delay)
        .withColumn("at", F.unix_micros("event_time"))
    )
    # Windows begin at multiples of their length since 1970.
    sliced = rows.groupBy("owner_key", F.window("event_time", f"{step_seconds} seconds").alias("_window")).agg(
        F.collect_list(F.struct("at", "tie", "digest")).alias("_held")
    ).select("owner_key", F.unix_micros("_window.start").alias("slice"), F.inline(slice_changes(F.col("_held"))))
    shard = F.pmod(F.xxhash64("owner_key"), F.lit(SHARDS)).cast("int")
    changed = sliced.drop("changed").withColumn("shard", shard).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=OwnerChanges(emit_first),
        outputStructType=f"owner_key string, at long, tie {tie_type}",
        outputMode="Append", timeMode="None",
    )
    return changed.select(
        F.from_json("owner_key", f"by {owner_type}")["by"].alias(by), F.timestamp_micros("at").alias(time),
        F.col("tie").alias(tie),
    )


def with_texts(keys: DataFrame, texts: DataFrame, by: str, time: str, tie: str) -> DataFrame:
    """The rows of ``texts`` that the keys name; rows without owner are found too."""
    wanted = keys.select(F.col(by).alias("_by"), F.col(time).cast("timestamp").alias("_at"), F.col(tie).alias("_tie"))
    same = texts[by].eqNullSafe(F.col("_by")) & (texts[time].cast("timestamp") == F.col("_at")) & (
        texts[tie] == F.col("_tie")
    )
    return texts.join(wanted.distinct(), same, "left_semi")


def unpaused_in_event_time(
    alerts: DataFrame, pauses: DataFrame, by: str, time: str, seconds: int, delay: str = "10 minutes"
) -> DataFrame:
    """Alerts without a pause of the same owner in ``[pause, pause + seconds)``, by event time.

    A left outer interval join of two streams: an alert waits until the watermark says that
    no pause can still hide it, and comes out once if none did; alerts and pauses that can
    meet nothing more leave the state.  A pause may arrive after the alert it hides, within
    ``delay``.  Rows without owner count as one owner; alerts without time come out never.
    """
    owner = F.to_json(F.struct(F.col(by).alias("by")))
    raised = alerts.withColumn("_owner", owner).withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    control = pauses.select(owner.alias("_paused"), F.col(time).cast("timestamp").alias("_from")).withWatermark("_from", delay)
    until = F.col("_from") + F.expr(f"INTERVAL {seconds} SECONDS")
    hidden = (F.col("_owner") == F.col("_paused")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < until)
    return raised.join(control, hidden, "left_outer").filter("_paused is null").select(*alerts.columns)
