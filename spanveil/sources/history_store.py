"""History on disk: two typed Parquet tables, and a tolerant reader for JSON lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spanveil import fixed_values as V
from spanveil.functions.labels import clean_variant_numbers

SCAN_SCHEMA = (
    "timestamp string, source string, finding_count int, types array<string>, text_length int"
)
REDACTION_SCHEMA = (
    "id string, timestamp string, source string, kind string, line_numbers array<int>, "
    "original_text string, redacted_text string"
)


def append(records: DataFrame, path: str, keep_history: bool = True) -> None:
    """Add records, one folder per day; with history off nothing is written."""
    if keep_history:
        dated = records.withColumn("day", F.substring("timestamp", 1, 10))
        dated.write.mode("append").partitionBy("day").parquet(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved records, or none when nothing was saved yet.

    Records with an id that is there already (an append that ran twice) count once.
    """
    try:
        saved = spark.read.schema(f"{schema}, day string").parquet(path).drop("day")
        return saved.dropDuplicates(["id"]) if "id" in saved.columns else saved
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def clear(spark: SparkSession, path: str, schema: str) -> None:
    """Remove every record, whatever overwrite mode the session has."""
    empty = spark.createDataFrame([], f"{schema}, day string")
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        "day"
    ).parquet(path)


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON history files, one row each (``owner`` is the path); no files, no rows."""
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "owner string, history string")
    return files.select(F.col("_metadata.file_path").alias("owner"),
                        F.col("value").alias("history"))


def parse_entries(texts: DataFrame, history: str = "history") -> DataFrame:
    """One row per list element: other columns, ``position``, ``entry`` (variant).

    Text that is not JSON, or not a list, counts as an empty list.
    """
    keys = [c for c in texts.columns if c != history]
    entries = F.from_json(F.col(history), "array<variant>", {"mode": "PERMISSIVE"})
    return texts.select(*keys, F.posexplode(entries).alias("position", "entry"))


def unusable(texts: DataFrame, history: str = "history") -> DataFrame:
    """Histories of which no record can be read: other columns and ``reason``."""
    shape = F.schema_of_variant(F.try_parse_json(history))
    reason = (
        F.when(F.col(history).isNull(), V.HISTORY_MISSING)
        .when(shape.isNull(), V.HISTORY_INVALID)
        .when(~shape.startswith("ARRAY"), V.HISTORY_NO_LIST)
    )
    return texts.withColumn("reason", reason).filter("reason is not null").drop(history)


def _kind(entry: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(entry, path, "variant"))


def _text(entry: Column, name: str) -> Column:
    """A field's value when it is a JSON string, else null."""
    return F.when(
        _kind(entry, f"$.{name}") == "STRING", F.try_variant_get(entry, f"$.{name}", "string")
    )


def split_redactions(texts: DataFrame, history: str = "history") -> tuple[DataFrame, DataFrame]:
    """(valid redaction records, rejected elements with the reason).

    A record needs a non-blank string id and string texts; its id is trimmed and its
    line numbers are cleaned.
    """
    keys = [c for c in texts.columns if c != history]
    entry = F.col("entry")
    record_id = F.regexp_replace(_text(entry, "id"), r"(?U)^\s+|\s+$", "")
    shape = F.schema_of_variant(entry)
    reason = (
        F.when(~F.coalesce(shape.startswith("OBJECT"), F.lit(False)), "not an object")
        .when(F.coalesce(record_id, F.lit("")) == "", "no usable id")
        .when(_text(entry, "original_text").isNull(), "original_text is not a string")
        .when(_text(entry, "redacted_text").isNull(), "redacted_text is not a string")
    )
    checked = parse_entries(texts, history).withColumn("reason", reason)
    numbers = F.try_variant_get(entry, "$.line_numbers", "array<variant>")
    valid = checked.filter("reason is null").select(
        *keys,
        "position",
        record_id.alias("id"),
        F.try_variant_get(entry, "$.timestamp", "string").alias("timestamp"),
        F.try_variant_get(entry, "$.source", "string").alias("source"),
        F.try_variant_get(entry, "$.kind", "string").alias("kind"),
        F.try_variant_get(entry, "$.file_name", "string").alias("file_name"),
        F.try_variant_get(entry, "$.finding_count", "int").alias("finding_count"),
        clean_variant_numbers(numbers).alias("line_numbers"),
        _text(entry, "original_text").alias("original_text"),
        _text(entry, "redacted_text").alias("redacted_text"),
    )
    rejected = checked.filter("reason is not null").select(
        *keys, "position", "reason", F.to_json("entry").alias("entry")
    )
    return valid, rejected
