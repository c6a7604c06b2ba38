"""Scan and redaction history: records, retention, and the review of one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil import fixed_values as V
from spanveil.functions.labels import display_time, line_label, plural
from spanveil.functions.lines import split_lines
from spanveil.operators.joins import lookup_join

SCAN_COLUMNS = ("timestamp", "source", "finding_count", "types", "text_length")
REDACTION_COLUMNS = (
    "id", "timestamp", "source", "kind", "line_numbers", "original_text", "redacted_text"
)


def iso_utc(moment: Column) -> Column:
    """ISO text in UTC, which sorts as text the way it sorts in time."""
    utc = F.to_utc_timestamp(moment.cast("timestamp"), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def scan_records(
    summary: DataFrame, moment: Column, source: Column, *keys: str, with_id: bool = False
) -> DataFrame:
    """Metadata-only records from ``report.summarize``; the text never gets here.

    ``with_id`` adds ``id``, a digest of keys, time and source: a scan that is saved twice is
    one record when the history is loaded.
    """
    parts = [F.col(k).cast("string") for k in keys]
    name = F.sha2(F.concat_ws("\x1f", *parts, iso_utc(moment), source), 256).alias("id")
    return summary.select(
        *keys,
        *([name] if with_id else []),
        iso_utc(moment).alias("timestamp"),
        source.alias("source"),
        F.col("line_type_count").alias("finding_count"),
        "types",
        "text_length",
    )


def redaction_records(
    redacted: DataFrame, moment: Column, source: Column, *keys: str, text: str = "text"
) -> DataFrame:
    """Full records of rows that were changed.

    The id is a digest of keys, time and source, so a repeated task writes the same id.
    """
    stamp = iso_utc(moment)
    parts = [F.col(k).cast("string") for k in keys]
    positive = F.array_sort(F.array_distinct(F.filter("line_numbers", lambda n: n > 0)))
    return redacted.filter("redacted").select(
        *keys,
        F.sha2(F.concat_ws("\x1f", *parts, stamp, source), 256).alias("id"),
        stamp.alias("timestamp"),
        source.alias("source"),
        F.lit("redaction").alias("kind"),
        positive.alias("line_numbers"),
        F.col(text).alias("original_text"),
        "redacted_text",
    )


_SALTS = 32


def newest(
    records: DataFrame, limit: int | str, by: list[str], time: str, tie: str,
    default: int = V.SETTING_DEFAULTS["history_limit"],
) -> DataFrame:
    """The newest ``max(1, limit)`` records of each owner.

    ``limit`` is one number for all, or the name of a column that holds the owner's own;
    where that is null, ``default`` counts.  Records are ranked within salted parts of an owner first and the survivors ranked
    again, so an owner with a third of all records is spread over tasks.  For limits up
    to 1,000 Spark also cuts each input partition to the limit before the first shuffle.
    """
    if isinstance(limit, str):
        most = F.greatest(F.lit(1), F.coalesce(F.col(limit).cast("int"), F.lit(default)))
    else:
        most = F.lit(max(1, int(limit)))
    order = [F.col(time).desc(), F.col(tie)]
    salted = records.withColumn("_salt", F.pmod(F.xxhash64(*by, tie), F.lit(_SALTS)))
    for owner in ([*by, "_salt"], by):
        rank = F.row_number().over(Window.partitionBy(*owner).orderBy(*order))
        salted = salted.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")
    return salted.drop("_salt")


def newest_by_settings(
    records: DataFrame, settings: DataFrame, by: str, tenant: str, time: str, tie: str
) -> DataFrame:
    """The newest records of each owner, as many as its settings say (``history_limit``).

    Owners without settings keep the default number, owners who keep no history nothing.
    """
    wanted = settings.select(
        F.col(tenant).alias(by), F.col("history_limit").alias("_limit"), F.col("keep_history").alias("_keep")
    )
    known = lookup_join(records, wanted, [by], "left", [tie])
    kept = known.filter(F.coalesce("_keep", F.lit(V.SETTING_DEFAULTS["keep_history"])))
    return newest(kept, "_limit", [by], time, tie).select(*records.columns)


def newest_overall(records: DataFrame, limit: int, time: str, tie: str) -> DataFrame:
    """The same for a single owner: top-k, merged from each partition's own top-k."""
    return records.orderBy(F.col(time).desc(), F.col(tie)).limit(max(1, int(limit)))


def can_open() -> Column:
    """Whether a record can be reviewed."""
    return (
        (F.coalesce(F.col("kind"), F.lit("")) == "redaction")
        & F.col("id").isNotNull()
        & F.col("original_text").isNotNull()
        & F.col("redacted_text").isNotNull()
    )


def history_view(records: DataFrame, *keys: str) -> DataFrame:
    """What a history list shows for each record."""
    lines = F.coalesce("line_numbers", F.array().cast("array<int>"))
    affected = F.when(F.size(lines) > 0, F.size(lines)).otherwise(
        F.coalesce("finding_count", F.lit(0))
    )
    return records.select(
        *keys,
        display_time(F.col("timestamp")).alias("happened"),
        line_label(lines).alias("line_label"),
        plural(affected, "affected line", "affected lines").alias("affected"),
        F.replace("redacted_text", F.lit("\n"), F.lit(" ")).alias("preview"),
        F.col("source"),
        can_open().alias("can_open"),
    )


def resolve(records: DataFrame, pointers: DataFrame, by: str) -> DataFrame:
    """Per owner the record to review: the selected one, else the newest, with a note.

    ``records`` have unique ids per owner; ``pointers`` hold ``by`` and ``selected_id``
    (null when unusable).  Choosing works on keys only: texts are fetched last, by
    owner and id, so an owner with very many records is still spread.
    """
    last = records.groupBy(by).agg(
        F.max(F.struct(F.coalesce("timestamp", F.lit("")).alias("t"), F.col("id"))).alias("_last")
    )
    selected = pointers.groupBy(by).agg(F.max("selected_id").alias("selected_id"))
    known = records.select(by, F.col("id").alias("selected_id"), F.lit(True).alias("_known"))
    state = last.join(selected, by, "full").join(known, [by, "selected_id"], "left")
    found = F.coalesce("_known", F.lit(False))
    note = (
        F.when(F.col("_last").isNull(), V.NOTE_NO_RECORDS)
        .when(found, F.lit(None).cast("string"))
        .when(F.col("selected_id").isNotNull(), V.NOTE_NOT_FOUND)
        .otherwise(V.NOTE_NO_SELECTION)
    )
    mode = (
        F.when(F.col("_last").isNull(), "")
        .when(found, V.MODE_SELECTED)
        .otherwise(V.MODE_NEWEST)
    )
    chosen = state.select(
        by,
        F.when(found, F.col("selected_id")).otherwise(F.col("_last.id")).alias("id"),
        mode.alias("mode"),
        note.alias("note"),
    )
    return chosen.join(records, [by, "id"], "left")


def review_header(resolved: DataFrame, *keys: str) -> DataFrame:
    """Title, time and number of flagged lines of a resolved record."""
    columns = resolved.columns
    file_name = F.col("file_name") if "file_name" in columns else F.lit(None).cast("string")
    title = F.coalesce(
        F.nullif(file_name, F.lit("")), F.nullif(F.col("source"), F.lit("")),
        F.lit(V.DEFAULT_SOURCE),
    )
    stamp = F.coalesce(F.nullif(F.col("timestamp"), F.lit("")), F.lit(V.UNKNOWN_TIME))
    flagged = F.size(F.array_distinct(F.coalesce("line_numbers", F.array().cast("array<int>"))))
    return resolved.select(
        *keys,
        "id",
        title.alias("title"),
        F.concat_ws("  •  ", F.col("mode"), stamp,
                    plural(flagged, "flagged line", "flagged lines")).alias("subtitle"),
        "note",
    )


def aligned_lines(records: DataFrame, *keys: str) -> DataFrame:
    """Original and redacted text line by line, equal lines beside each other.

    ``review_lines`` (see ``redact``) tell the original lines without a line of their own on
    the redacted side: '' stands beside them and they count as flagged.  All others follow
    in order, so a replaced block of lines moves nothing below it.
    """
    every = F.sequence(F.lit(1), F.size("_original"))
    folded = F.col("review_lines.folded")
    beside = F.concat(
        F.zip_with(F.array_except(every, folded), F.col("_redacted"), lambda n, b: F.struct(
            n.alias("line_no"), F.coalesce(b, F.lit("")).alias("redacted_line"), F.lit(False).alias("folded"))),
        F.transform(folded, lambda n: F.struct(
            n.alias("line_no"), F.lit("").alias("redacted_line"), F.lit(True).alias("folded"))),
    )
    rows = records.withColumn("_original", split_lines(F.col("original_text"), "normalized")).withColumn(
        "_redacted", split_lines(F.col("redacted_text"), "normalized")
    ).select(*keys, F.col("review_lines.flagged").alias("_flagged"), "_original", F.inline(beside))
    return rows.select(
        *keys, "line_no", F.get("_original", F.col("line_no") - 1).alias("original_line"), "redacted_line",
        (F.col("folded") | F.array_contains("_flagged", F.col("line_no"))).alias("flagged"),
    )


def side_by_side(records: DataFrame, *keys: str) -> DataFrame:
    """Original and redacted text line by line; the shorter side is filled with ''."""
    pairs = F.zip_with(
        split_lines(F.col("original_text"), "normalized"),
        split_lines(F.col("redacted_text"), "normalized"),
        lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("original_line"),
                              F.coalesce(b, F.lit("")).alias("redacted_line")),
    )
    rows = records.select(*keys, "line_numbers", F.posexplode(pairs).alias("_pos", "_pair"))
    line_no = F.col("_pos") + 1
    return rows.select(
        *keys,
        line_no.alias("line_no"),
        "_pair.original_line",
        "_pair.redacted_line",
        F.array_contains("line_numbers", line_no).alias("flagged"),
    )
