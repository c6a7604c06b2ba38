"""Precision, recall and F of findings against labelled spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(found: DataFrame, gold: DataFrame, keys: list[str], entity: str = "entity") -> DataFrame:
    """One row per entity and one for all (entity null).

    Both sides are stacked and counted per span, so repeats collapse before the shuffle
    and no span key can grow hot.
    """
    span = [*keys, entity]
    both = found.select(*span, F.lit(1).alias("f"), F.lit(0).alias("g")).union(
        gold.select(*span, F.lit(0).alias("f"), F.lit(1).alias("g"))
    )
    spans = both.groupBy(*span).agg(F.max("f").alias("f"), F.max("g").alias("g"))
    counts = spans.rollup(entity).agg(
        F.sum(F.col("f") * F.col("g")).alias("hits"),
        F.sum("f").alias("found"),
        F.sum("g").alias("gold"),
    )
    p = F.try_divide("hits", "found")
    r = F.try_divide("hits", "gold")
    total = F.col("found") + F.col("gold")
    return counts.select(
        entity, "hits", "found", "gold", p.alias("p"), r.alias("r"),
        F.try_divide(2 * F.col("hits"), total).alias("f"),
    )
