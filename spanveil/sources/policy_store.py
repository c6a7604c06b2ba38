"""Settings on disk: JSON text in, sorted JSON text out, replaced as a whole or by tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spanveil.operators.policy import read_settings, settings_json
from spanveil.sources import versions


def saved_texts(spark: SparkSession, path: str, key: str = "tenant") -> DataFrame:
    """``key, settings`` as saved here, or of JSON files, each one tenant named by its path."""
    schema = f"{key} string, settings string"
    if versions.log_of(spark, path):
        return versions.read(spark, path, schema, key)
    try:
        return spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias(key), F.col("value").alias("settings")
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_settings(spark: SparkSession, path: str, key: str = "tenant") -> DataFrame:
    """Saved settings, defaults filled in, unknown keys kept: one row per ``key``.

    Nothing saved gives no rows; ``Policy()`` holds the defaults.
    """
    return read_settings(saved_texts(spark, path, key), keep_unknown=True)


def _texts(settings: DataFrame, key: str) -> DataFrame:
    texts = settings if "settings" in settings.columns else settings_json(settings, key)
    return texts.select(key, "settings")


def save_settings(settings: DataFrame, path: str, key: str = "tenant") -> int:
    """Make these the only settings; they may come from ``path``.  Readers see the old table
    until the new one is whole.  Keys are sorted inside each text."""
    return versions.replace(_texts(settings, key), path)


def update_settings(settings: DataFrame, path: str, key: str = "tenant") -> int:
    """Save the settings of some tenants; those of all others are not touched or rewritten."""
    return versions.change(_texts(settings, key), path)
