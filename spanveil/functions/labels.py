"""How findings and records are worded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil import fixed_values as V


def percent(score: Column) -> Column:
    """Whole percent, cut off rather than rounded."""
    return (score * 100).cast("int")


def score_text(score: Column) -> Column:
    return F.format_string("%.2f", score)


def entity_label(entity: Column) -> Column:
    return F.initcap(F.translate(entity, "_", " "))


def severity(confidence: Column) -> Column:
    return F.when(confidence <= V.AMBER_MAX_PERCENT, "amber").otherwise("red")


def masked_preview(match: Column, shown: int = 4) -> Column:
    return F.concat(F.substring(match, 1, shown), F.lit("..."))


def scan_message(line_no: Column, entity: Column, confidence: Column, match: Column) -> Column:
    return F.concat(
        F.lit("Line "), line_no.cast("string"), F.lit(": "), entity, F.lit(" ("),
        confidence.cast("string"), F.lit("% '"), match, F.lit("')"),
    )


def alert_line(line_no: Column, entity: Column, confidence: Column) -> Column:
    return F.concat(
        F.lit("• Line "), line_no.cast("string"), F.lit(": "), entity_label(entity),
        F.lit(" ("), confidence.cast("string"), F.lit("%)"),
    )


def sensitive_line_message(line_no: Column, types: Column, line: Column) -> Column:
    return F.concat(
        F.lit("Line "), line_no.cast("string"), F.lit(" ("), F.array_join(types, ", "),
        F.lit("): "), line,
    )


def audit_message(line_no: Column, entity: Column, match: Column, score: Column) -> Column:
    prefix = F.concat(F.lit("Line "), line_no.cast("string"), F.lit(" | "))
    found = F.concat(
        F.lit("Type: "), entity, F.lit(" | Text: '"), match, F.lit("' | Confidence: "),
        score_text(score),
    )
    return F.concat(prefix, F.coalesce(found, F.lit("Clean")))


def _whole(text: Column) -> Column:
    """Text of a signed whole number, blanks around and single underscores inside allowed."""
    number = F.regexp_replace(text, r"[\s_]", "").try_cast("int")
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*$"), number)


def _clean(numbers: Column) -> Column:
    kept = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n > 0)))
    return F.coalesce(kept, F.array().cast("array<int>"))


def clean_line_numbers(values: Column) -> Column:
    """Positive whole numbers, distinct and sorted, from an array of strings.

    Anything else is dropped; a null array becomes an empty one.
    """
    return _clean(F.transform(values, _whole))


def clean_variant_numbers(values: Column) -> Column:
    """The same for an ``array<variant>``: fractions are cut off, true counts as 1."""
    def number(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        text = F.try_variant_get(value, "$", "string")
        return (
            F.when(kind.rlike("^(?:DECIMAL|DOUBLE|FLOAT)"), text.try_cast("double").try_cast("int"))
            .when(kind == "BOOLEAN", (text == "true").cast("int"))
            .otherwise(_whole(text))
        )

    return _clean(F.transform(values, number))


def line_label(line_numbers: Column) -> Column:
    joined = F.array_join(line_numbers.cast("array<string>"), ", ")
    return F.concat(
        F.lit("Lines: "), F.when(F.size(line_numbers) > 0, joined).otherwise(V.NO_LINES)
    )


def plural(count: Column, one: str, many: str) -> Column:
    return F.concat(count.cast("string"), F.lit(" "), F.when(count == 1, one).otherwise(many))


def display_time(timestamp: Column) -> Column:
    """ISO text to a short local label; the session time zone is the local one."""
    parsed = F.try_to_timestamp(timestamp)
    return F.coalesce(F.date_format(parsed, V.DISPLAY_TIME_FORMAT), F.lit(V.UNKNOWN_TIME))
