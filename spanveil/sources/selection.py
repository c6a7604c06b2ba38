"""The pointer to the record under review: three accepted JSON shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.functions.lines import is_nonblank
from spanveil.sources import versions


def selected_id(pointer: Column) -> Column:
    """``{"id": ...}``, ``{"redaction_id": ...}`` or a bare string; null when unusable.

    ``redaction_id`` counts only where ``id`` is absent, and only strings count.
    """
    value = F.try_parse_json(pointer)

    def string_at(path: str) -> Column:
        part = F.try_variant_get(value, path, "variant")
        return F.when(F.schema_of_variant(part) == "STRING",
                      F.try_variant_get(value, path, "string"))

    has_id = F.try_variant_get(value, "$.id", "variant").isNotNull()
    bare = F.when(F.schema_of_variant(value) == "STRING",
                  F.try_variant_get(value, "$", "string"))
    text = F.coalesce(bare, F.when(has_id, string_at("$.id")).otherwise(string_at("$.redaction_id")))
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.nullif(trimmed, F.lit(""))


def read_pointers(table: DataFrame, by: str, pointer: str = "pointer") -> DataFrame:
    return table.select(by, selected_id(F.col(pointer)).alias("selected_id"))


def pointer_json(record_id: Column) -> Column:
    return F.to_json(F.struct(F.trim(record_id).alias("id")))


def write_pointers(selected: DataFrame, path: str, by: str, record_id: str = "id") -> int:
    """Make these the only pointers, one per owner; blank ids are not written."""
    usable = selected.filter(is_nonblank(F.col(record_id)))
    return versions.replace(usable.select(by, pointer_json(F.col(record_id)).alias("pointer")), path)


def change_pointers(selected: DataFrame, path: str, by: str, record_id: str = "id") -> int:
    """Write the pointers of these owners; all others stay as they are and are not rewritten."""
    usable = selected.filter(is_nonblank(F.col(record_id)))
    return versions.change(usable.select(by, pointer_json(F.col(record_id)).alias("pointer")), path)


def saved_pointers(spark: SparkSession, path: str, by: str) -> DataFrame:
    """``by, selected_id`` of every owner who has a pointer."""
    return read_pointers(versions.read(spark, path, f"{by} string, pointer string", by), by)


def select_record(spark: SparkSession, path: str, by: str, owner: str, record_id: str) -> None:
    """Point one owner at a record; a blank id is refused."""
    if not str(record_id).strip():
        raise ValueError("a record id is required")
    change_pointers(spark.createDataFrame([(owner, record_id)], f"{by} string, id string"), path, by)
