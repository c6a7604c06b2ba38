"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments.  Two codes within distance d agree in some segment up to
d // segments bits, so after all segments were searched up to radius r every code within
``segments * (r + 1) - 1`` bits has been met.  The radius grows by one per round, only
for queries whose k-th verified distance is not yet covered.

Vectors of equal code share one entry that keeps their count and their smallest k + 1
ids, which is all a top-k needs; queries of equal code are searched once.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import cut, pick, stored

SALTS = 64
WORD_BITS = 32


def sign_code(vector: Column, bits: int) -> Column:
    """Bit i is 1 where component i is above 0; words of 32 bits, null and missing components count as 0."""
    def word(start: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(start, min(start + WORD_BITS, bits)):
            up = F.coalesce(F.get(vector, F.lit(i)) > 0, F.lit(False))
            out = out.bitwiseOR(F.when(up, F.lit(1 << (i - start))).otherwise(F.lit(0)).cast("long"))
        return out
    return F.array(*[word(start) for start in range(0, bits, WORD_BITS)])


def distance(a: str, b: str, words: int) -> Column:
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i))))
    return total


def segment_values(code: str, bits: int, segments: int) -> Column:
    """The value of each segment; bit i of the code belongs to segment i mod ``segments``."""
    values = []
    for s in range(segments):
        value = F.lit(0).cast("long")
        for place, i in enumerate(range(s, bits, segments)):
            bit = F.shiftright(F.get(F.col(code), F.lit(i // WORD_BITS)), i % WORD_BITS).bitwiseAND(F.lit(1))
            value = value.bitwiseOR(F.shiftleft(bit, place))
        values.append(value)
    return F.array(*values)


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """``code, n, ids``: per code its count and its smallest k + 1 ids, hot codes in salted parts first."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    parts = salted.groupBy("code", "salt").agg(F.count("*").alias("n"))
    counts = parts.groupBy("code").agg(F.sum("n").alias("n"))
    inside = F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))
    few = salted.withColumn("turn", inside).filter(F.col("turn") <= k + 1).drop("turn")
    among = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    first = few.withColumn("turn", among).filter(F.col("turn") <= k + 1).groupBy("code").agg(
        F.array_sort(F.collect_list("id")).alias("ids")
    )
    return counts.join(first, "code")


def masks(width: int, radius: int) -> Column:
    """All values of ``width`` bits with ``radius`` ones, as one constant array."""
    values = ",".join(str(sum(1 << i for i in ones)) for ones in combinations(range(width), radius))
    return F.split(F.lit(values), ",").cast("array<long>")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    bits: int = 64,
    segments: int = 4,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, neighbor_id, distance``: the k nearest rows of each query row.

    ``is_query`` is an expression over the id column, null counts as no.  Nearness is the Hamming
    distance of the sign codes, ties go to the smaller id; a row is not its own neighbour.
    Ids are taken to be unique: rows without id are left out, of repeated ids the row
    with the smallest code counts.  A null or short vector has zeros for what is missing; fewer than
    k + 1 rows give shorter lists; an empty table gives an empty result.
    """
    words = -(-bits // WORD_BITS)
    rows = cut(
        pick(vectors, **{id_col: id_col}, vector=vector_col).filter(F.col(id_col).isNotNull())
        .select(F.col(id_col), F.coalesce(is_query, F.lit(False)).alias("asks"), sign_code(F.col("vector"), bits).alias("code"))
        .withColumnRenamed(id_col, "id").groupBy("id").agg(F.min("code").alias("code"), F.max("asks").alias("asks"))
    )
    codes = smallest_ids(rows, k)
    index = stored(
        codes.select("code", "n", "ids", F.posexplode(segment_values("code", bits, segments)).alias("segment", "value")),
        "index",
    )
    width = [len(range(s, bits, segments)) for s in range(segments)]
    asked = cut(rows.filter("asks").select(F.col("code").alias("query")).distinct())
    probes = stored(
        asked.select("query", F.posexplode(segment_values("query", bits, segments)).alias("segment", "value")), "probes"
    )
    # A query needs k neighbours besides itself, so k + 1 ids of the codes met.
    best, open_ = None, asked
    for radius in range(max(width) + 1):
        flipped = None
        for s in range(segments):
            if comb(width[s], radius):
                part = probes.filter(F.col("segment") == s).join(open_, "query", "left_semi").select(
                    "query", "segment", F.explode(F.transform(masks(width[s], radius), lambda m: F.col("value").bitwiseXOR(m))).alias("value")
                )
                flipped = part if flipped is None else flipped.unionByName(part)
        met = (
            # Sizes are judged before the masks multiply the probes: never broadcast them.
            flipped.hint("merge").join(index, ["segment", "value"])
            .select("query", "code", "n", "ids", distance("query", "code", words).alias("distance")).distinct()
        )
        known = met if best is None else best.unionByName(met).distinct()
        # Only codes that fewer than k + 1 ids are nearer than can be in a top k.
        best = cut(
            known.withColumn("nearer", F.coalesce(F.sum("n").over(
                Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
            ), F.lit(0))).filter(F.col("nearer") <= k).drop("nearer")
        )
        covered = segments * (radius + 1) - 1
        done = best.filter(F.col("distance") <= covered).groupBy("query").agg(F.sum("n").alias("n")).filter(F.col("n") > k)
        open_ = cut(open_.join(done, "query", "left_anti"))
        if not open_.head(1):
            break
    found = best.select("query", "distance", F.explode("ids").alias("neighbor_id"))
    turn = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor_id"))
    near = found.withColumn("turn", turn).filter(F.col("turn") <= k + 1)
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))
    asking = rows.filter("asks").select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    others = F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("query_id")), 1, k)
    return asking.join(lists, "query").select("query_id", F.posexplode(others).alias("at", "one")).select(
        "query_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("one.neighbor_id").alias("neighbor_id"),
        F.col("one.distance").cast("long").alias("distance"),
    )
