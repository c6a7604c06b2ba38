"""Line dedup: lines that many documents share leave all of them.

Method: lines are exploded with their position, normalised and hashed; the distinct
documents of a hash are counted; lines of frequent hashes go; the rest is put together
again by position.  Only column functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import SPACES, ascii_lower, cut, digest, kept, pick, restored


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def frequent_lines(docs: DataFrame, min_docs: int, min_length: int) -> DataFrame:
    """Rows ``doc_key, pos`` of the lines whose key is in ``min_docs`` documents or more.

    Counts come first from map-side sums over all lines; only lines of keys that could
    pass are then told apart by document, so no hot key is gathered anywhere.
    """
    lines = (
        docs.select("doc_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_key", "pos", line_key(F.col("line")).alias("line"))
        .filter(F.char_length("line") >= min_length)
        .select("doc_key", "pos", F.unhex(F.md5("line")).alias("line_hash"))
    )
    seen = lines.groupBy("line_hash").count().filter(F.col("count") >= min_docs).select("line_hash")
    # Counts are stored before they are joined: with an exchange on both sides a hot line
    # can be split over tasks.
    found = cut(lines.join(cut(seen), "line_hash").distinct())
    spread = (
        found.select("line_hash", "doc_key").distinct()
        .groupBy("line_hash").count().filter(F.col("count") >= min_docs).select("line_hash")
    )
    return found.join(cut(spread), "line_hash", "left_semi").select("doc_key", "pos")


def drop_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_length: int = 1,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, kept columns, ``text, n_lines, n_dropped, dropped``.

    ``dropped`` holds the positions (from 0) of the lines that went, ascending.  A null
    or empty text has one empty line.  A document is an id with its text: repeated rows
    count as one document and all get the same result; rows without id count by their
    text.  Lines shorter than ``min_length`` code points after stripping always stay.
    An empty table gives an empty result.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, **kept(keep)).withColumn(
        "text", F.coalesce("text", F.lit(""))
    ).withColumn("doc_key", digest(F.col("doc_id"), F.col("text")))
    gone = frequent_lines(rows, min_docs, min_length).groupBy("doc_key").agg(
        F.array_sort(F.collect_set("pos")).alias("dropped")
    )
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("dropped"))
    joined = rows.join(gone, "doc_key", "left").withColumn("n_lines", F.size(lines).cast("long"))
    text = F.when(F.col("dropped").isNull(), F.col("text")).when(
        F.size("dropped") == F.col("n_lines"), F.lit("")
    ).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return (
        joined.withColumn("lines", F.when(F.col("dropped").isNotNull(), lines))
        .select(
            F.col("doc_id").alias(id_col),
            *restored(keep),
            text.alias("text"),
            "n_lines",
            F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
            F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        )
    )
