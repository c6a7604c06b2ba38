"""Files taken in as they come; what cannot be read is noted, left aside and tried again.

The stream watches names only.  Each micro-batch hands its readable files to a function; a
file that fails gets a row in a ledger with the reason and the number of attempts, and the
stream goes on.  Every later micro-batch, or ``take_in_waiting`` at any time, tries the files
of the ledger again until they can be read or have had their attempts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from spanveil.sources import versions

LEDGER = "path string, attempts int, reason string, done boolean, tried timestamp"
FILES = "path string, modificationTime timestamp, length long, content binary"
ATTEMPTS = 10
REASON = 500

Process = Callable[[DataFrame, str], None]


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per file that could not be read at some time; ``done`` once it could."""
    return versions.read(spark, ledger, LEDGER, "path")


def failure(spark: SparkSession, path: str, schema: StructType, format: str) -> str | None:
    """Why a file cannot be read to its end, or None if it can."""
    try:
        spark.read.format(format).schema(schema).load(path).write.format("noop").mode("overwrite").save()
    except Exception as error:  # noqa: BLE001  whatever a reader raises is the reason
        return str(error).strip().split("\n")[0][:REASON]
    return None


def take_in_files(
    spark: SparkSession, paths: list[str], schema: StructType, process: Process, ledger: str, name: str,
    format: str = "parquet", tried: dict[str, int] | None = None,
) -> list[str]:
    """Process the readable ones of some files and write the others to the ledger.

    ``process`` gets all rows and a name that is the same when the same files come again; it
    must replace what it wrote under that name.  Only if reading fails, files are tried one
    by one.  An error that no file explains is raised.
    """
    tried = tried or {}

    def rows_of(files: list[str]) -> DataFrame:
        return spark.read.format(format).schema(schema).load(files)

    reasons: dict[str, str] = {}
    good = list(paths)
    if good:
        try:
            process(rows_of(good), name)
        except Exception:
            reasons = {p: why for p in good if (why := failure(spark, p, schema, format)) is not None}
            if not reasons:
                raise
            good = [p for p in good if p not in reasons]
            if good:
                process(rows_of(good), name)
    noted = [(p, tried.get(p, 0) + 1, why, False) for p, why in reasons.items()]
    noted += [(p, tried[p] + 1, None, True) for p in good if p in tried]
    if noted:
        rows = spark.createDataFrame(noted, LEDGER.rsplit(",", 1)[0]).withColumn("tried", F.current_timestamp())
        versions.change(rows, ledger)
    return good


def take_in_waiting(
    spark: SparkSession, schema: StructType, process: Process, ledger: str, format: str = "parquet",
    most: int = 100, attempts: int = ATTEMPTS,
) -> list[str]:
    """Try the files that wait in the ledger, those first that were tried longest ago.

    Each file is handed on under a name of its own, so one that is read at last replaces
    nothing else.  The files that were read.
    """
    waiting = ledger_rows(spark, ledger).filter(~F.col("done") & (F.col("attempts") < attempts))
    found = []
    for row in waiting.orderBy("tried", "path").limit(most).collect():
        name = f"file-{spark.range(1).select(F.sha2(F.lit(row['path']), 256)).first()[0][:16]}"
        found += take_in_files(
            spark, [row["path"]], schema, process, ledger, name, format, {row["path"]: row["attempts"]}
        )
    return found


def take_in(
    spark: SparkSession, path: str, schema: StructType, process: Process, ledger: str, checkpoint: str,
    glob: str | None = None, files_per_batch: int = 100, format: str = "parquet",
    attempts: int = ATTEMPTS, available_now: bool = False, poll: str = "10 seconds",
) -> StreamingQuery:
    """Watch a folder and process its files, each once, however many of them are broken."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def handle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # A micro-batch that is run again finds its own files in the ledger.
        known = {r["path"]: r["attempts"] for r in ledger_rows(session, ledger).filter("not done").collect()}
        names = sorted(r["path"] for r in batch.collect())
        fresh = [p for p in names if p not in known]
        take_in_files(session, fresh, schema, process, ledger, f"batch-{number}", format)
        take_in_waiting(session, schema, process, ledger, format, files_per_batch, attempts)

    writer = reader.load(path).select("path").writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=poll)
    return writer.start()
