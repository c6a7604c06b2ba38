"""Reports built from findings: per line, per document, clean lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil import fixed_values as V
from spanveil.functions.arrays import empty_array, let
from spanveil.functions.labels import audit_message, sensitive_line_message
from spanveil.functions.lines import explode_lines
from spanveil.functions.spans import SPAN
from spanveil.operators.detect import any_match, detect_spans, hit_lines, line_findings, line_rules
from spanveil.operators.rules import Rule


def types_of(spans: Column) -> Column:
    """Sorted distinct entities of an array of spans; a missing one is 'Unknown'."""
    names = F.transform(spans, lambda s: F.coalesce(s["entity"], F.lit("Unknown")))
    return F.array_sort(F.array_distinct(names))


def sensitive_lines(
    docs: DataFrame, rules: Iterable[Rule], text: str = "text", lang: str | None = None
) -> DataFrame:
    """Lines with at least one finding: keys, ``line_no``, ``types``, ``line``, ``message``.

    A line's findings sit in one row, so its types need no shuffle.
    """
    rules = line_rules(rules)
    keys = [c for c in docs.columns if c != text]
    kind = "struct<types:array<string>>"
    found = let(
        types_of(detect_spans(F.col("line"), rules, F.col(lang) if lang else None)),
        lambda t: F.when(F.size(t) > 0, F.array(F.struct(t.alias("types")))).otherwise(
            empty_array(kind)
        ),
    )
    rows = hit_lines(docs, rules, text).select(*keys, "line_no", "line", F.inline(found))
    return rows.select(
        *keys, "line_no", "types", "line",
        sensitive_line_message(F.col("line_no"), F.col("types"), F.col("line")).alias("message"),
    )


def summarize(
    docs: DataFrame, rules: Iterable[Rule], text: str = "text", lang: str | None = None
) -> DataFrame:
    """One metadata row per document, never its text.

    ``span_count`` counts findings, ``line_type_count`` distinct (line, type) pairs.
    """
    keys = [c for c in docs.columns if c != text]
    found = docs.select(
        *keys,
        F.length(text).alias("text_length"),
        line_findings(F.col(text), rules, F.col(lang) if lang else None).alias("found"),
    )
    return summary_columns(found, keys)


def summary_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries from rows that carry their findings (``found``) and ``text_length``."""
    pairs = F.transform(F.col("found"), lambda f: F.struct(f["line_no"], f["entity"]))
    return rows.select(
        *keys,
        F.size("found").alias("span_count"),
        F.size(F.array_distinct(pairs)).alias("line_type_count"),
        types_of(F.col("found")).alias("types"),
        F.size(F.array_distinct(F.col("found.line_no"))).alias("affected_lines"),
        "text_length",
        (F.size("found") > 0).alias("leak"),
    )


def _line_spans(rules: Iterable[Rule], lang: str | None) -> Column:
    """Spans of a line; most lines are done with after the first look."""
    rules = line_rules(rules)
    spans = detect_spans(F.col("line"), rules, F.col(lang) if lang else None)
    return F.when(any_match(F.col("line"), rules), spans).otherwise(empty_array(SPAN))


def audit(
    docs: DataFrame, rules: Iterable[Rule], text: str = "text", lang: str | None = None
) -> DataFrame:
    """Every non-blank line: one row per finding, or one 'Clean' row."""
    keys = [c for c in docs.columns if c != text]
    lines = explode_lines(docs, text, skip_blank=True)
    rows = lines.select(*keys, "line_no", F.inline_outer(_line_spans(rules, lang)))
    return rows.select(
        *keys, "line_no", F.coalesce("entity", F.lit("Clean")).alias("entity"),
        "start", "end", "score", "match",
        audit_message(F.col("line_no"), F.col("entity"), F.col("match"), F.col("score"))
        .alias("message"),
    )


def clean_lines(
    docs: DataFrame, rules: Iterable[Rule], text: str = "text", lang: str | None = None
) -> DataFrame:
    """Non-blank lines without a finding."""
    lines = explode_lines(docs, text, skip_blank=True)
    return lines.filter(F.size(_line_spans(rules, lang)) == 0)


def count_findings(findings: DataFrame, *by: str) -> DataFrame:
    """Findings, documents' lines and best confidence per group."""
    return findings.groupBy(*by).agg(
        F.count("*").alias("findings"),
        F.max("confidence").alias("best_confidence"),
    )


def detector_labels(spark: SparkSession) -> DataFrame:
    """The fixed label table: entity, label, description."""
    rows = [(key, *texts) for key, texts in V.DETECTOR_LABELS.items()]
    return spark.createDataFrame(rows, "entity string, label string, description string")


def with_labels(findings: DataFrame) -> DataFrame:
    """Adds display texts; entities of custom rules get their own name as label."""
    labels = F.broadcast(detector_labels(findings.sparkSession))
    return findings.join(labels, "entity", "left").withColumn(
        "label", F.coalesce("label", "entity")
    )
