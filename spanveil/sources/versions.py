"""Keyed tables on disk that are replaced or changed without ever being half there.

A save writes its rows to a folder of its own and then adds one row to the log, which
names the folder.  Readers know only what the log names, so a save that breaks off before
its log row leaves the table as it was; nothing that is read is ever overwritten.  A save
of some keys is a change: readers take each key's row from the newest save that has it.
Within a save a key has one row.
``compact`` writes the present rows as one whole save, after which older ones can go.

One writer at a time: two at once may give two saves the same number, of which the later
log row counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LOG_FOLDER = "_log"
LOG = "number long, folder string, whole boolean, note long, at timestamp"


def log_of(spark: SparkSession, path: str) -> list:
    """Log rows from the last whole save on, oldest first; none if nothing was saved."""
    try:
        rows = spark.read.schema(LOG).json(f"{path}/{LOG_FOLDER}").orderBy("number", "at", "folder").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    wholes = [at for at, row in enumerate(rows) if row["whole"]]
    return rows[wholes[-1]:] if wholes else rows


def stage(rows: DataFrame, path: str) -> str:
    """Write rows to a new folder that no reader knows yet; its name."""
    folder = f"save={uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(f"{path}/{folder}")
    return folder


def publish(spark: SparkSession, path: str, folder: str, whole: bool, note: int | None = None) -> int:
    """Add the folder to the log: from here on readers see it.  The number of the save.

    ``note`` is a number of the writer's own, for instance how far it has read.
    """
    seen = log_of(spark, path)
    number = seen[-1]["number"] + 1 if seen else 1
    row = spark.createDataFrame([(number, folder, whole, note)], LOG.rsplit(",", 1)[0])
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{path}/{LOG_FOLDER}")
    return number


def replace(rows: DataFrame, path: str, note: int | None = None) -> int:
    """Make ``rows``, which may come from ``path``, the whole table."""
    return publish(rows.sparkSession, path, stage(rows, path), True, note)


def change(rows: DataFrame, path: str) -> int:
    """Put ``rows`` in place of the rows with their keys; all other keys stay untouched."""
    return publish(rows.sparkSession, path, stage(rows, path), False)


def read(spark: SparkSession, path: str, schema: str, *keys: str) -> DataFrame:
    """The present rows, one per key for keys that were changed; null keys are keys too.

    ``schema`` is that of a table nothing was saved to; saved columns keep their types.
    """
    log = log_of(spark, path)
    if not log:
        return spark.createDataFrame([], schema)
    parts = [
        spark.read.parquet(f"{path}/{row['folder']}").withColumn("_save", F.lit(at)) for at, row in enumerate(log)
    ]
    if len(parts) == 1 and log[0]["whole"]:
        return parts[0].drop("_save")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    columns = [c for c in rows.columns if c != "_save"]
    newest = F.max_by(F.struct(*columns), "_save").alias("_row")
    return rows.groupBy(*[F.struct(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(newest).select("_row.*")


def compact(spark: SparkSession, path: str, schema: str, *keys: str) -> int:
    """Write the present rows as one whole save."""
    return replace(read(spark, path, schema, *keys), path)


def files_at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove_old(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders that the present rows do not need, half-written ones included.

    Readers that started before the last whole save may still want them, so this is for
    quiet hours.  Names what was deleted.
    """
    files, place = files_at(spark, path)
    wanted = {row["folder"] for row in log_of(spark, path)}
    if not wanted:
        return []
    names = [status.getPath().getName() for status in files.listStatus(place)]
    gone = [name for name in names if name.startswith("save=") and name not in wanted]
    for name in gone:
        files.delete(files_at(spark, f"{path}/{name}")[1], True)
    return gone
