"""Mixing sources to target weights by entropy balancing.

Every document starts at one copy.  Among all rates between 0 and ``most`` copies that
meet the token target of each source, the rates closest to the start in (bounded)
entropy are ``most * sigmoid(lambda_source * size)`` shifted to 1 at lambda 0: an
exponential tilt along the document's size.  The lambdas solve the convex dual; each
Newton step is one distributed sum over the classes (source, size).  Rates become whole
copies along the size order of a source, so that the running error stays below half a
document, and a last step at the small end takes up what is left.  Only column
functions are used; the driver sees a few sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import WORD, cut, kept, pick, restored

# Documents of one class (source, size) that one task ranks.
CELL = 65_536
# Sizes summed by one task of a running sum.
BAND = 256
STEPS = 80


def by_code_point(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 in code point order, null last, without one task for all."""
    null_last = [F.col("source").isNull(), F.col("source")]
    parts = cut(sources.repartitionByRange(*null_last).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*null_last)) - 1
    return parts.withColumn("inside", inside).join(starts, "part").withColumn(
        "rank", F.col("start") + F.col("inside")
    ).drop("part", "inside", "start")


def with_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, rank, source_size) with ``target``: shares by weight, none above its cap.

    The capped shares are ``min(cap, weight * level)``; the level rises with the set of
    capped sources until that set stays, and only the level and two sums leave the cluster.
    """
    turn = (F.col("rank") % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    rows = cut(sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")))
    total = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total[0]:
        return rows.withColumn("target", F.lit(0.0)).drop("weight", "cap")
    budget, level, full = share * total[0], share * total[0] / total[1], -1
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        n, caps, free = rows.agg(
            F.count_if(capped), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))),
        ).first()
        if n == full or not free:
            break
        full, level = n, (budget - caps) / free
    target = F.least("cap", F.col("weight") * level)
    return rows.withColumn("target", target).drop("weight", "cap")


def rate(most: float) -> Column:
    """Copies a document of ``size`` should have on average, 1 where lambda is 0."""
    start = F.lit(most - 1.0)
    return F.when(F.col("full"), F.lit(float(most))).otherwise(
        most / (1.0 + start * F.exp(-F.col("lambda") * F.col("size") / F.col("mean")))
    )


def solved(classes: DataFrame, sources: DataFrame, most: float) -> DataFrame:
    """``sources`` with ``lambda``: Newton steps on the dual, all sources at once.

    From 0 the steps come to the root from one side, so they need no line search.
    """
    state = cut(sources.select(
        "rank", "target", "mean", (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lambda"), F.lit(False).alias("done"),
    ))
    for _ in range(STEPS):
        r, u = rate(most), F.col("size") / F.col("mean")
        sums = classes.join(state.filter(~F.col("full") & ~F.col("done")), "rank").groupBy("rank").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("mass"),
            F.sum(F.col("n") * F.col("size") * u * r * (1 - r / most)).alias("slope"),
        )
        miss = F.col("mass") - F.col("target")
        near = F.abs(miss) <= F.greatest(F.lit(0.25), 1e-9 * F.col("target"))
        state = cut(state.join(sums, "rank", "left").select(
            "rank", "target", "mean", "full",
            F.when(~near & (F.col("slope") > 0), F.col("lambda") - miss / F.col("slope"))
            .otherwise(F.col("lambda")).alias("lambda"),
            (F.col("full") | F.col("done") | F.coalesce(near | (F.col("slope") <= 0), F.lit(True))).alias("done"),
        ))
        if not state.filter(~F.col("done")).head(1):
            break
    return state.drop("done")


def running(df: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: sum of ``value`` over the smaller sizes of the same source, in two levels."""
    banded = df.withColumn("band", F.floor(F.col("size") / BAND))
    before = Window.partitionBy("rank").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("rank", "band").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    bands = banded.groupBy("rank", "band").agg(F.sum(value).alias("sum_")).select(
        "rank", "band", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("start_")
    )
    return banded.join(bands, ["rank", "band"]).withColumn(
        out, F.col("start_") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    ).drop("band", "start_")


def rounded(classes: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """Classes with ``low`` copies for every document and one more for ``extra`` of its ``n``."""
    rates = classes.join(state, "rank").withColumn("rate", rate(most)).withColumn(
        "low", F.least(F.floor("rate"), F.lit(int(most)))
    ).withColumn("part", F.col("n") * (F.col("rate") - F.col("low")))
    first = cut(running(rates, "part", "before").withColumn(
        "extra",
        F.greatest(F.lit(0), F.least("n", F.floor(F.col("before") + F.col("part") + 0.5)
                                     - F.floor(F.col("before") + 0.5))),
    ).select("rank", "size", "n", "low", "extra", "target"))
    return filled(cut(flipped(cut(filled(first, most)), most)), most).select("rank", "size", "n", "low", "extra")


def with_miss(classes: DataFrame, most: float) -> DataFrame:
    """Classes with the words that the source still misses (below 0: has too many) and the copies free to change."""
    taken = F.sum(F.col("size") * (F.col("n") * F.col("low") + F.col("extra")))
    miss = classes.groupBy("rank").agg(F.round(F.max("target") - taken).cast("long").alias("miss"))
    free = F.when((F.col("size") == 0) | (F.col("low") >= most), 0).when(
        F.col("miss") > 0, F.col("n") - F.col("extra")
    ).otherwise(F.col("extra"))
    return classes.join(miss, "rank").withColumn("free", free)


def filled(classes: DataFrame, most: float) -> DataFrame:
    """The smallest documents that can, take up what their source misses or give what it has too many."""
    room = running(
        with_miss(classes, most).withColumn("words", F.col("free") * F.col("size")), "words", "used"
    )
    left = F.greatest(F.lit(0), F.abs("miss") - F.col("used"))
    moved = F.least("free", F.floor(left / F.greatest("size", F.lit(1))))
    return room.select(
        "rank", "size", "n", "low", (F.col("extra") + F.signum("miss") * moved).cast("long").alias("extra"), "target"
    )


def flipped(classes: DataFrame, most: float) -> DataFrame:
    """One document of a size between once and twice the miss changes sides, where there is one."""
    near = with_miss(classes, most)
    fits = (F.col("free") > 0) & (F.col("size") >= F.abs("miss")) & (F.col("size") < 2 * F.abs("miss"))
    chosen = near.filter(fits).groupBy("rank").agg(F.min("size").alias("chosen"))
    step = F.when(F.col("size") == F.col("chosen"), F.signum("miss")).otherwise(0)
    return near.join(chosen, "rank", "left").select(
        "rank", "size", "n", "low", (F.col("extra") + step).cast("long").alias("extra"), "target"
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, kept columns, ``size, source_size, target, copies, taken``.

    ``size`` counts runs of characters that are not ASCII white space (null text: 0);
    sources in code point order, null last, weigh ``weights`` in turn and share ``share``
    times all words, none above ``most`` times its own.  ``taken`` is size times copies.
    Which documents of a class get the further copy follows a hash of the id, so reruns
    agree.  Repeated rows are rows of their own; texts without words take nothing; a
    source of no words has target 0; an empty table gives an empty result.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col, **kept(keep)).withColumn(
        "size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    )
    counted = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs")
    ).withColumn("mean", F.greatest(F.lit(1e-9), F.col("source_size") / F.col("docs")))
    targets = cut(with_targets(by_code_point(sources), weights, share, most))
    same = counted["source"].eqNullSafe(targets["source"])
    classes = cut(counted.join(targets, same).select("rank", "size", "n"))
    copies = cut(rounded(classes, solved(classes, targets, most), most))

    named = cut(copies.join(targets.withColumnRenamed("source", "name"), "rank").select(
        "name", F.col("size").alias("words"), "n", "low", "extra", "source_size", "target",
        F.ceil(F.col("n") / CELL).alias("cells"),
    ))
    mark = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix"))
    joined = rows.withColumn("mark", mark).join(
        named, F.col("source").eqNullSafe(F.col("name")) & (F.col("size") == F.col("words"))
    ).withColumn("cell", F.pmod("mark", "cells"))
    # A class of more documents than a task should rank is dealt into cells by the hash.
    dealt = Window.partitionBy("name", "words").orderBy("cell")
    shares = (
        rows.withColumn("mark", mark)
        .join(named.filter("cells > 1"), F.col("source").eqNullSafe(F.col("name")) & (F.col("size") == F.col("words")))
        .withColumn("cell", F.pmod("mark", "cells"))
        .groupBy("name", "words", "cell", "n", "extra").agg(F.count("*").alias("here"))
        .withColumn("upto", F.sum("here").over(dealt))
        .select(
            F.col("name").alias("name_"), F.col("words").alias("words_"), F.col("cell").alias("cell_"),
            (F.floor(F.col("extra") * F.col("upto") / F.col("n"))
             - F.floor(F.col("extra") * (F.col("upto") - F.col("here")) / F.col("n"))).alias("extra_"),
        )
    )
    order = Window.partitionBy("name", "words", "cell").orderBy("mark", "doc_id")
    return (
        joined.join(
            shares,
            F.col("name").eqNullSafe(F.col("name_")) & (F.col("words") == F.col("words_"))
            & (F.col("cell") == F.col("cell_")), "left",
        )
        .withColumn("turn", F.row_number().over(order))
        .withColumn("copies", (F.col("low") + F.when(F.col("turn") <= F.coalesce("extra_", "extra"), 1).otherwise(0)).cast("long"))
        .select(
            F.col("doc_id").alias(id_col), F.col("source").alias(source_col), *restored(keep), "size", "source_size",
            F.col("target").cast("double").alias("target"), "copies",
            (F.col("size") * F.col("copies")).alias("taken"),
        )
    )
