"""Where texts come from and where redacted texts go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanveil.functions.lines import LINE_BREAK, is_nonblank
from spanveil.operators.joins import lookup_join


def read_table(spark: SparkSession, path: str, *columns: str, format: str = "parquet") -> DataFrame:
    """A table of texts; only the named columns are read."""
    rows = spark.read.format(format).load(path)
    return rows.select(*columns) if columns else rows


def spread(docs: DataFrame, *keys: str) -> DataFrame:
    """Give a small input enough partitions for every core.

    Scanning costs far more than reading, so a table in a few files would leave most
    cores idle.  An input that already has a partition per core is left alone, so large
    tables are never shuffled here.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() >= cores:
        return docs
    return docs.repartition(2 * cores, *keys)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: ``doc_id`` (its path) and ``text``; blank files are left out."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )
    return files.filter(is_nonblank(F.col("text")))


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The non-blank lines of text files: ``doc_id`` (path), ``line_no``, ``line``.

    Files are split by byte range, so one large file is read by many tasks and no row holds
    more than a line.  Each split counts its lines; the counts of a file's splits before are
    added to a line's number in its own.  Lines break as in ``explode_lines``.
    """
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # A line feed after a carriage return is one break, which the split has taken already.
    own = F.regexp_replace("value", r"\r\z", "")
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"), F.split(own, LINE_BREAK, -1).alias("_lines"),
    )
    # One row per split of a file.
    splits = rows.groupBy("doc_id", "_split").agg(
        F.min("_row").alias("_first"), F.sum(F.size("_lines") - 1).alias("_more"), F.count("*").alias("_count")
    )
    before = Window.partitionBy("doc_id").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "doc_id", "_split", "_first", "_more",
        F.coalesce(F.sum(F.col("_more") + F.col("_count")).over(before), F.lit(0)).alias("_before"),
    )
    placed = lookup_join(rows, starts, ["doc_id", "_split"], "inner", ["_row"])
    plain = placed.filter("_more = 0").select(
        "doc_id", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line_no"),
        F.element_at("_lines", 1).alias("line"),
    )
    # Only splits that hold rarer breaks count them row by row; a split is of bounded size.
    inside = Window.partitionBy("doc_id", "_split").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    other = placed.filter("_more > 0").withColumn(
        "_inside", F.coalesce(F.sum(F.size("_lines")).over(inside), F.lit(0))
    ).select("doc_id", "_before", "_inside", F.posexplode("_lines").alias("_pos", "line")).select(
        "doc_id", (F.col("_before") + F.col("_inside") + F.col("_pos") + 1).alias("line_no"), "line"
    )
    found = plain.unionByName(other).withColumn("line_no", F.col("line_no").cast("int"))
    return found.filter(is_nonblank(F.col("line")))


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """A single given text; blank text is refused."""
    frame = spark.createDataFrame([(0, text)], "doc_id long, text string")
    if not text.strip():
        raise ValueError("provide text to scan")
    return frame


def write_redacted(redacted: DataFrame, path: str, *columns: str, source_path: str | None = None) -> None:
    """Write the safe texts; never over the place they were read from."""
    if source_path is not None and source_path.rstrip("/") == path.rstrip("/"):
        raise ValueError("redacted text must not replace its source")
    redacted.select(*columns, "redacted_text").write.mode("errorifexists").parquet(path)
