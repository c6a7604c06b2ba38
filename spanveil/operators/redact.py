"""Redaction: overlapping spans merged, each replaced, the text around them kept."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil import fixed_values as V
from spanveil.functions.arrays import empty_array, let
from spanveil.functions.spans import SPAN, affected_lines, merge_spans, span_lines, splice
from spanveil.operators.detect import any_match, document_spans
from spanveil.operators.rules import Rule, with_threshold

MODES = ("placeholder", "mask", "hash", "drop")


def replacement(
    span: Column, hit: Column, mode: str, preserve_newlines: bool, key: str | None = None
) -> Column:
    """What stands in place of a hit; ``hash`` needs a secret key, or short values could be
    found by trying them all."""
    if mode == "placeholder":
        out = F.concat(F.lit("<"), span["entity"], F.lit(">"))
    elif mode == "mask":
        out = F.repeat(F.lit("*"), F.length(hit))
    elif mode == "hash":
        if not key:
            raise ValueError("mode 'hash' needs a key")
        inner = F.sha2(F.concat(F.lit(key), F.lit("\x1f"), hit), 256)
        out = F.sha2(F.concat(F.lit(key), F.lit("\x1e"), inner), 256)
    elif mode == "drop":
        out = F.lit("")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if preserve_newlines:
        out = F.concat(out, F.regexp_replace(hit, r"[^\n]+", ""))
    return out


def redact_spans(
    text: Column, spans: Column, mode: str = "placeholder", preserve_newlines: bool = False,
    key: str | None = None,
) -> Column:
    """The text with its spans replaced."""
    return splice(
        text, merge_spans(spans),
        lambda span, hit: replacement(span, hit, mode, preserve_newlines, key),
    )


def review_lines(text: Column, spans: Column) -> Column:
    """``struct<flagged, folded>``: the lines in which a span starts, and those that replacing
    the spans folds into the line before, both ascending.

    A span that goes over a line break takes the break with it, so the line after the break
    continues the line the span began on.  Lines as in a review: every kind of break counts.
    """
    def lines_of(bound: Column) -> Column:
        first = span_lines(bound["text"], bound["spans"])
        return let(first, lambda n: F.struct(F.array_distinct(n).alias("flagged"), folds(bound, n).alias("folded")))

    def folds(bound: Column, first: Column) -> Column:
        breaks = F.transform(bound["spans"], lambda s: F.length(F.regexp_replace(
            F.substring(bound["text"], s["start"] + 1, s["end"] - s["start"]), r"[^\n]+", "")))
        return F.flatten(F.zip_with(
            first, breaks, lambda n, k: F.when(k > 0, F.sequence(n + 1, n + k)).otherwise(empty_array("int"))
        ))

    # One character stands for each kind of break, so places in the text stay as they are.
    one = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\u0002\n")), F.lit("\r"), F.lit("\n"))
    points = F.transform(merge_spans(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return let(F.struct(one.alias("text"), points.alias("spans")), lines_of)


def redact(
    docs: DataFrame,
    rules: Iterable[Rule],
    text: str = "text",
    mode: str = "placeholder",
    preserve_newlines: bool = False,
    lang: str | None = None,
    threshold: float = V.REDACT_THRESHOLD,
    key: str | None = None,
    with_folds: bool = False,
) -> DataFrame:
    """Adds ``redacted``, ``span_count``, ``line_numbers`` and ``redacted_text``.

    Rows without a finding keep their text; null text stays null.  The whole job is
    one pass over the rows.  ``with_folds`` adds ``review_lines`` for a review: the
    lines that are flagged there, and those that it cannot show beside a line of their own
    because a replaced span took their break.
    """
    rules = with_threshold(rules, threshold)
    source = F.col(text)
    lang_col = F.col(lang) if lang else None
    spans = F.when(any_match(source, rules), document_spans(source, rules, lang_col))
    # A generator: filters on the outcome stay above it, so detection runs once.
    found = docs.select("*", F.explode(F.array(F.coalesce(spans, empty_array(SPAN)))).alias("_spans"))
    some = F.size("_spans") > 0
    no_lines = empty_array("int")
    lines = F.when(some, affected_lines(source, F.col("_spans"))).otherwise(no_lines)
    clean = F.when(
        some, redact_spans(source, F.col("_spans"), mode, preserve_newlines, key)
    ).otherwise(source)
    none = F.struct(no_lines.alias("flagged"), no_lines.alias("folded"))
    shown = F.when(some, review_lines(source, F.col("_spans"))).otherwise(none)
    if preserve_newlines:
        shown = shown.withField("folded", no_lines)
    return found.select(
        *docs.columns,
        some.alias("redacted"),
        F.size("_spans").alias("span_count"),
        lines.alias("line_numbers"),
        clean.alias("redacted_text"),
        *([shown.alias("review_lines")] if with_folds else []),
    )


def redact_requested(
    requests: DataFrame, docs: DataFrame, rules: Iterable[Rule], on: list[str], text: str = "text"
) -> DataFrame:
    """Redact only what was asked for: requests are made unique, then looked up by key."""
    wanted = requests.select(*on).distinct()
    return redact(docs.join(wanted, on, "left_semi"), rules, text).filter("redacted")
