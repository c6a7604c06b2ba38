"""The continuous monitor: watch texts, scan what changed, write what was found.

Detection is the same column code as in batch and runs once per changed text.  Each
micro-batch writes its findings under its own number and derives everything else from
them, so a repeated batch replaces its output instead of adding to it.  Texts are never
written, and matches only in part unless asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from spanveil import fixed_values as V
from spanveil.functions.labels import masked_preview
from spanveil.operators.alerts import alert_columns, suppress_paused
from spanveil.operators.detect import finding_columns, line_findings
from spanveil.operators.history import newest, scan_records
from spanveil.operators.joins import lookup_join
from spanveil.operators.redact import redact
from spanveil.operators.report import summary_columns
from spanveil.operators.rules import Rule
from spanveil.sources import versions
from spanveil.streaming.ordered import changed_keys, with_texts
from spanveil.streaming.state import changed_rows, prepare

POLL = "200 milliseconds"


def read_texts(
    spark: SparkSession, path: str, schema: StructType, glob: str | None = None,
    files_per_batch: int = 100, format: str = "parquet", skip_unreadable: bool = False,
) -> DataFrame:
    """A folder watched for new files.

    A file that cannot be read fails the micro-batch, which is tried again with the same
    files when the query starts anew; ``skip_unreadable`` passes over it for good.
    """
    reader = (
        spark.readStream.format(format).schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("ignoreCorruptFiles", skip_unreadable)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def requested_redactions(
    requests: DataFrame, texts: DataFrame, on: list[str], rules: Iterable[Rule],
    request_time: str, text_time: str, text: str = "text",
    within: str = "1 hour", late: str = "10 minutes",
) -> DataFrame:
    """Redact a text when a request for it arrives no later than ``within`` after it.

    A text comes out once, with its own columns, however often it is asked for.  Both streams
    carry a watermark, so texts nobody asks for leave the state.
    """
    asked = requests.withWatermark(request_time, late).alias("r")
    held = texts.withWatermark(text_time, late).alias("t")
    same = [F.col(f"r.{c}") == F.col(f"t.{c}") for c in on]
    timely = (F.col(f"r.{request_time}") >= F.col(f"t.{text_time}")) & (
        F.col(f"r.{request_time}") <= F.col(f"t.{text_time}") + F.expr(f"INTERVAL {within}")
    )
    return redact(held.join(asked, [*same, timely], "left_semi"), rules, text).filter("redacted")


def _shortened(found: Column) -> Column:
    """Findings with the start of the match in place of the match."""
    return F.transform(found, lambda f: f.withField("match", masked_preview(f["match"])))


def fan_out(
    rules: Iterable[Rule], out: str, by: str, time: str, tie: str, text: str = "text",
    subscriber: Callable[[DataFrame, int], None] | None = None,
    pauses: Callable[[SparkSession], DataFrame] | None = None,
    keep_history: bool = True, mask: bool = True,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes changes, findings, alerts, summaries and history.

    ``pauses`` reads the pauses (``by``, ``time``) known when the batch runs; alerts
    raised during one are left out.  History records hold no text and no match.
    """
    rules = list(rules)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = [c for c in batch.columns if c != text]

        def put(name: str, rows: DataFrame) -> DataFrame:
            folder = f"{out}/{name}/batch={number}"
            rows.write.mode("overwrite").parquet(folder)
            return spark.read.schema(rows.schema).parquet(folder)

        found = line_findings(F.col(text), rules)
        changed = put("changes", batch.select(
            *keys, F.length(text).alias("text_length"), (_shortened(found) if mask else found).alias("found")
        ))
        put("findings", finding_columns(changed.select(*keys, F.inline("found")), keys))
        raised = alert_columns(changed.filter(F.size("found") > 0), keys)
        if pauses is not None:
            raised = suppress_paused(raised, pauses(spark), by, time, [tie])
        raised = put("alerts", raised)
        summary = put("summary", summary_columns(changed, keys))
        if keep_history:
            put("history", scan_records(summary, F.col(time), F.lit(V.SCAN_SOURCE), by, tie))
        if subscriber is not None:
            subscriber(raised, number)

    return write


def _merged(spark: SparkSession, out: str) -> tuple[DataFrame | None, int]:
    """What ``compact_history`` has kept, and the last micro-batch that is in it."""
    log = versions.log_of(spark, f"{out}/kept")
    if not log:
        return None, -1
    return versions.read(spark, f"{out}/kept", ""), log[-1]["note"]


def all_history(spark: SparkSession, out: str) -> DataFrame:
    """History records that were kept, and those of the micro-batches since."""
    kept, last = _merged(spark, out)
    try:
        fresh = spark.read.parquet(f"{out}/history").filter(F.col("batch") > last).drop("batch")
    except AnalysisException as error:
        # All micro-batches are merged and gone.
        if kept is None or error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return kept
    return fresh if kept is None else kept.unionByName(fresh)


def bounded_history(spark: SparkSession, out: str, limit: int, by: str, tie: str) -> DataFrame:
    """The newest ``limit`` history records of each owner over all micro-batches."""
    return newest(all_history(spark, out), limit, [by], "timestamp", tie)


def compact_history(
    spark: SparkSession, out: str, by: str, tie: str, limit: int = V.SETTING_DEFAULTS["history_limit"],
    limits: DataFrame | None = None, oldest: str | None = None,
) -> DataFrame:
    """Make the history on disk shrink to what is to be kept; gives what is left.

    The micro-batches so far are merged with what was kept before; of each owner the newest
    ``limit`` records stay, or as many as ``limits`` (``by``, ``history_limit``) says, and
    none from before ``oldest`` (a timestamp as the records have it).  Only when the merged
    table stands whole do the micro-batches and older tables go; if that breaks off, the next
    call finishes it, and readers never count a record twice.
    """
    last = _merged(spark, out)[1]
    files, place = versions.files_at(spark, f"{out}/history")
    numbers = [
        int(status.getPath().getName().split("=")[1]) for status in (files.listStatus(place) if files.exists(place) else [])
        if status.getPath().getName().startswith("batch=")
    ]
    if any(number > last for number in numbers) or last >= 0:
        rows = all_history(spark, out)
        if oldest is not None:
            rows = rows.filter(F.col("timestamp") >= oldest)
        if limits is None:
            rows = newest(rows, limit, [by], "timestamp", tie)
        else:
            own = limits.select(by, F.col("history_limit").alias("_limit"))
            rows = newest(
                lookup_join(rows, own, [by], "left", [tie]), "_limit", [by], "timestamp", tie, limit
            ).drop("_limit")
        last = max([last, *numbers])
        versions.replace(rows, f"{out}/kept", note=last)
    for number in numbers:
        if number <= last:
            files.delete(versions.files_at(spark, f"{out}/history/batch={number}")[1], True)
    versions.remove_old(spark, f"{out}/kept")
    return all_history(spark, out)


def monitor(
    stream: DataFrame, rules: Iterable[Rule], out: str, checkpoint: str,
    by: str, time: str, tie: str, text: str = "text",
    scan_enabled: bool = True, available_now: bool = False,
    subscriber: Callable[[DataFrame, int], None] | None = None,
    pauses: Callable[[SparkSession], DataFrame] | None = None,
    keep_history: bool = True, mask: bool = True, poll: str = POLL,
    texts: Callable[[SparkSession], DataFrame] | None = None,
    delay: str = "10 minutes", step_seconds: int = 60,
) -> StreamingQuery:
    """Start watching.  ``out`` and ``checkpoint`` are folders every executor can reach.

    Changes are per owner ``by``; the first text of an owner is the baseline.  With
    ``texts``, which reads the watched texts from where they are kept, changes follow event
    time (see ``ordered.changed_keys``), late rows take their place, and no text enters the
    state, so one owner may have most of the rows.
    """
    prepare(stream.sparkSession)
    watched = stream.filter(F.lit(scan_enabled))
    write = fan_out(rules, out, by, time, tie, text, subscriber, pauses, keep_history, mask)
    if texts is None:
        changed = changed_rows(watched, by, time, tie, text)
    else:
        changed = changed_keys(watched, by, time, tie, text, delay, step_seconds)
        write_texts = write

        def write(batch: DataFrame, number: int) -> None:
            write_texts(with_texts(batch, texts(batch.sparkSession), by, time, tie), number)

    writer = changed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = (
        writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=poll)
    )
    return writer.start()
