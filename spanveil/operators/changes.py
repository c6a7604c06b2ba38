"""Consecutive-change detection per owner, split so that no owner is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64
# Rows that a slice should hold, over all owners.
SLICE_ROWS = 4_000_000


def time_cuts(rows: DataFrame, time: str, slices: int = SLICES) -> list[str]:
    """At most ``slices - 1`` values of ``time`` that split the rows evenly, as text.

    Reads the one column; any cuts give the same result, even ones only the balance.
    """
    shares = [i / slices for i in range(1, slices)]
    found = rows.agg(
        F.percentile_approx(time, shares, 1_000).cast("array<string>").alias("cuts")
    ).first()["cuts"]
    # Shares ascend, so the values do: their order as text would not balance numbers.
    return list(dict.fromkeys(found or []))


def slice_number(value: Column, cuts: list[str], kind: str) -> Column:
    """Which slice a value falls in: a balanced tree of comparisons; nulls come first."""
    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(cuts[middle]).cast(kind), between(low, middle)).otherwise(
            between(middle + 1, high)
        )

    return F.when(value.isNull(), 0).otherwise(between(0, len(cuts)))


def changes(
    rows: DataFrame,
    by: str,
    time: str,
    tie: str,
    value: str,
    emit_first: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Rows whose ``value`` differs from the owner's row before, by ``time`` and ``tie``.

    An owner's first value is the baseline and is not reported unless ``emit_first``.
    Null values (a failed read) are skipped.  Each owner is cut into time slices of
    even overall size, as many as the rows ask for; a slice's first row looks at the last value of the owner's
    slice before, taken from a summary of at most ``slices`` rows per owner.
    """
    rows = rows.filter(F.col(value).isNotNull())
    kind = dict(rows.dtypes)[time]
    if slices is None:
        slices = max(SLICES, -(-rows.count() // SLICE_ROWS))
    cuts = time_cuts(rows, time, slices)
    marked = rows.withColumn("_slice", slice_number(F.col(time), cuts, kind)).withColumn(
        "_now", F.sha2(value, 256)
    )
    inside = Window.partitionBy(by, "_slice").orderBy(time, tie)
    seen = marked.withColumn("_before", F.lag("_now").over(inside))
    last = marked.groupBy(by, "_slice").agg(
        F.max(F.struct(time, tie, "_now")).getField("_now").alias("_last")
    )
    across = Window.partitionBy(by).orderBy("_slice")
    carried = last.select(
        F.col(by).alias("_by"), F.col("_slice").alias("_at"),
        F.lag("_last").over(across).alias("_carried"),
    )
    # Null-safe, so rows without an owner count as one owner here too.
    same = seen[by].eqNullSafe(F.col("_by")) & (seen["_slice"] == F.col("_at"))
    joined = seen.join(carried, same, "left")
    before = F.coalesce("_before", "_carried")
    changed = F.col("_now") != before
    keep = F.coalesce(changed, F.lit(emit_first))
    return joined.filter(keep).select(*rows.columns)
