"""Rows in a total order, each with its place, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.session import ensure_checkpoint_dir

# monotonically_increasing_id: the number within the partition stands in the low bits.
_LOW = (1 << 33) - 1


def with_place(rows: DataFrame, *order: Column, place: str = "place") -> DataFrame:
    """Adds ``place``, from 1: where the row stands when all are sorted by ``order``.

    Rows are dealt to ranges of the order and sorted within; the rows of each range are
    counted, and the counts of the ranges before are added to a row's number in its own.
    Only these counts, one per range, meet in one place.  The dealt rows are stored, so
    both readings see the same ranges.  Rows that ``order`` does not tell apart share a
    range and get different places.  Written out as they are, files follow the order.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    dealt = (
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_number", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW)))
        .checkpoint()
    )
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    starts, before = [], 0
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _before long")
    return dealt.join(F.broadcast(offsets), "_part").select(
        *rows.columns, (F.col("_before") + F.col("_number") + 1).alias(place)
    )


def findings_order() -> list[Column]:
    """By document, line and position; what is left undecided goes by kind and rule."""
    return [F.col(c).asc() for c in ("doc_id", "line_no", "start", "end", "entity", "rule")]


def newest_order(time: str = "timestamp", tie: str = "id") -> list[Column]:
    return [F.col(time).desc(), F.col(tie).asc()]
