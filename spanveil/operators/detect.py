"""Finding rows: texts in, one row per match out.  Nothing here shuffles."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import empty_array, let, running_total
from spanveil.functions.labels import percent
from spanveil.functions.lines import explode_lines, is_nonblank, split_lines
from spanveil.functions.spans import SPAN, place_pieces, regex_pieces, sort_spans, span_lines
from spanveil.functions.validators import VALIDATORS
from spanveil.operators.joins import lookup_join
from spanveil.operators.rules import Rule, looks_around, may_cross_lines

LINE_FINDING = (
    "struct<line_no:int,entity:string,start:int,end:int,score:double,rule:string,match:string>"
)
FINDING_COLUMNS = ("line_no", "entity", "start", "end", "score", "confidence", "match", "rule")


def _groups(rules: Iterable[Rule]) -> list[list[Rule]]:
    """Rules asked together, as they share their first look; byte searches come first."""
    groups: dict[tuple, list[Rule]] = {}
    for rule in rules:
        groups.setdefault((rule.hint, rule.hint_regex, rule.needs), []).append(rule)
    return sorted(groups.values(), key=lambda members: not members[0].hint)


def _regex(rule: Rule) -> str:
    return rule.prefix_regex() + rule.engine_regex()


def _look(text: Column, rules: list[Rule]) -> Column | None:
    """Byte search for literals, or one short pattern; far cheaper than the rules."""
    literals = list(dict.fromkeys(h for rule in rules for h in rule.hints()))
    if literals:
        some = reduce(or_, [text.contains(literal) for literal in literals])
        return some & text.contains(rules[0].needs) if rules[0].needs else some
    return text.rlike(rules[0].hint_regex) if rules[0].hint_regex else None


def _in_language(test: Column, rule: Rule, lang: Column | None) -> Column:
    return (lang == rule.lang) & test if rule.lang is not None and lang is not None else test


def any_match(text: Column, rules: Iterable[Rule]) -> Column:
    """Whether some rule matches (validators and languages aside).

    Rules are grouped behind a shared first look, so the alternation of a group's
    patterns runs only where its own hint stands; one alternation of all patterns, or of
    those with different literals, costs several times as much.
    """
    tests = []
    for members in _groups(rules):
        found = text.rlike("(?s)" + "|".join(f"(?:{_regex(rule)})" for rule in members))
        look = _look(text, members)
        tests.append(found if look is None else look & found)
    return reduce(or_, tests) if tests else F.lit(False)


def _group_pieces(text: Column, members: list[Rule], lang: Column | None) -> Column:
    """What the rules of a group matched, one entry per rule or null where it matched nothing;
    null where the group's first look fails.  Patterns stay literals and are compiled once."""
    def pieces(rule: Rule) -> Column:
        test = _in_language(text.rlike("(?s)" + _regex(rule)), rule, lang)
        return F.when(
            test,
            F.struct(
                F.lit(rule.entity).alias("entity"),
                F.lit(float(rule.score)).alias("score"),
                F.lit(rule.name).alias("rule"),
                regex_pieces(text, rule.engine_regex(), rule.prefix_regex()).alias("found"),
            ),
        )

    look = _look(text, members)
    found = F.array(*map(pieces, members))
    return found if look is None else F.when(look, found)


def _valid(span: Column, rules: list[Rule]) -> Column:
    """Whether the span passes the check its rule names."""
    checked: dict[str, list[str]] = {}
    for rule in rules:
        if rule.validator:
            checked.setdefault(rule.validator, []).append(rule.name)
    test = F.lit(True)
    for validator, names in checked.items():
        test = F.when(span["rule"].isin(names), VALIDATORS[validator](span["match"])).otherwise(
            test
        )
    return test


def detect_spans(text: Column, rules: Iterable[Rule], lang: Column | None = None) -> Column:
    """All spans of all rules in one text, in position order; empty for null text.

    Only the extraction is spelled out per rule; placing, checking and sorting are said
    once for all of them, which keeps the plan short.
    """
    rules = list(rules)
    if not rules:
        return empty_array(SPAN)

    def spans_of(one: Column) -> Column:
        return F.transform(
            place_pieces(one["found"]),
            lambda s: F.struct(
                one["entity"].alias("entity"), s["start"].alias("start"), s["end"].alias("end"),
                one["score"].alias("score"), one["rule"].alias("rule"), s["match"].alias("match"),
            ),
        )

    per_group = F.array(*[_group_pieces(text, members, lang) for members in _groups(rules)])
    per_rule = F.flatten(F.array_compact(per_group))
    spans = F.flatten(F.transform(F.array_compact(per_rule), spans_of))
    if any(rule.validator for rule in rules):
        spans = F.filter(spans, lambda s: _valid(s, rules))
    return sort_spans(spans)


def document_spans(text: Column, rules: Iterable[Rule], lang: Column | None = None) -> Column:
    """``detect_spans`` for whole documents, offsets counting within the document.

    Rules that cannot match a line feed are run line by line and shifted: a document
    then pays for the rules only on the lines that hold something.
    """
    rules = list(rules)
    within = [rule for rule in rules if not may_cross_lines(rule)]
    across = [rule for rule in rules if may_cross_lines(rule)]
    if not within:
        return detect_spans(text, across, lang)

    def shifted(line: Column, ends: Column, index: Column) -> Column:
        start = F.get(ends, index) - F.length(line) - 1
        return F.transform(
            detect_spans(line, within, lang),
            lambda s: F.struct(
                s["entity"].alias("entity"), (s["start"] + start).alias("start"),
                (s["end"] + start).alias("end"), s["score"].alias("score"),
                s["rule"].alias("rule"), s["match"].alias("match"),
            ),
        )

    def all_lines(bound: Column) -> Column:
        return F.flatten(
            F.transform(bound["lines"], lambda line, i: shifted(line, bound["ends"], i))
        )

    def with_ends(lines: Column) -> Column:
        sizes = F.transform(lines, lambda line: F.length(line) + 1)
        return F.struct(lines.alias("lines"), running_total(sizes).alias("ends"))

    spans = let(let(F.split(text, "\n", -1), with_ends), all_lines)
    if across:
        spans = sort_spans(F.concat(spans, detect_spans(text, across, lang)))
    return spans


def line_findings(text: Column, rules: Iterable[Rule], lang: Column | None = None) -> Column:
    """Findings of a whole document, line by line, as one array of
    ``struct<line_no, entity, start, end, score, rule, match>``."""
    rules = line_rules(rules)
    none = empty_array(LINE_FINDING)

    def of_line(line: Column, index: Column) -> Column:
        spans = F.transform(
            detect_spans(line, rules, lang),
            lambda s: F.struct(
                (index + 1).alias("line_no"), s["entity"].alias("entity"),
                s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"),
                s["rule"].alias("rule"), s["match"].alias("match"),
            ),
        )
        return F.when(is_nonblank(line), spans).otherwise(none)

    found = F.flatten(F.transform(split_lines(text), of_line))
    if any(looks_around(rule) for rule in rules):
        return F.coalesce(found, none)
    return F.when(any_match(text, rules), found).otherwise(none)


def line_rules(rules: Iterable[Rule]) -> list[Rule]:
    """The rules for texts that are read line by line: one that spans lines looks for the
    line that stands for it, so no kind is left out."""
    return [
        replace(rule, pattern=rule.line_pattern, java="", multiline=False) if rule.multiline else rule
        for rule in rules
    ]


def hit_lines(
    docs: DataFrame, rules: Iterable[Rule], text: str = "text"
) -> DataFrame:
    """Numbered non-blank lines on which some rule may match.

    Texts without any match are dropped before they are split.
    """
    rules = line_rules(rules)
    if not any(looks_around(rule) for rule in rules):
        docs = docs.filter(any_match(F.col(text), rules))
    lines = explode_lines(docs, text, skip_blank=True)
    return lines.filter(any_match(F.col("line"), rules))


def scan(
    docs: DataFrame,
    rules: Iterable[Rule],
    text: str = "text",
    unit: str = "line",
    lang: str | None = None,
) -> DataFrame:
    """One row per finding: the other columns of ``docs`` plus ``FINDING_COLUMNS``.

    With ``unit="line"`` offsets count within the line; with ``unit="document"``
    they count within the text, and a span that crosses lines is given its first.
    """
    rules = list(rules)
    keys = [c for c in docs.columns if c != text]
    lang_col = F.col(lang) if lang else None
    if unit == "line":
        rows = hit_lines(docs, rules, text).select(
            *keys, "line_no", F.inline(detect_spans(F.col("line"), line_rules(rules), lang_col))
        )
    elif unit == "document":
        numbered = let(
            document_spans(F.col(text), rules, lang_col),
            lambda spans: F.zip_with(
                spans,
                span_lines(F.col(text), spans),
                lambda s, n: F.struct(
                    n.alias("line_no"), s["entity"].alias("entity"), s["start"].alias("start"),
                    s["end"].alias("end"), s["score"].alias("score"), s["rule"].alias("rule"),
                    s["match"].alias("match"),
                ),
            ),
        )
        rows = docs.filter(
            is_nonblank(F.col(text)) & any_match(F.col(text), rules)
        ).select(*keys, F.inline(numbered))
    else:
        raise ValueError(f"unknown unit {unit!r}")
    return finding_columns(rows, keys)


def scan_lines(
    lines: DataFrame, rules: Iterable[Rule], line: str = "line", lang: str | None = None
) -> DataFrame:
    """``scan`` for texts that are lines already (``line_no``, ``line`` and keys)."""
    rules = line_rules(rules)
    keys = [c for c in lines.columns if c not in (line, "line_no")]
    spans = detect_spans(F.col(line), rules, F.col(lang) if lang else None)
    rows = lines.filter(any_match(F.col(line), rules)).select(*keys, "line_no", F.inline(spans))
    return finding_columns(rows, keys)


def finding_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and ``FINDING_COLUMNS`` of rows with one finding each."""
    shown = [
        percent(F.col("score")).alias(c) if c == "confidence" else c for c in FINDING_COLUMNS
    ]
    return rows.select(*keys, *shown)


def allowed(
    findings: DataFrame, allow_list: DataFrame, on: list[str], spread_by: list[str]
) -> DataFrame:
    """Findings whose keys stand on the allow-list (many tenants, one scan)."""
    return lookup_join(findings, allow_list.select(*on).distinct(), on, "left_semi", spread_by)


def above(findings: DataFrame, threshold: float, inclusive: bool = False) -> DataFrame:
    """Confidence filter for findings that are already materialised."""
    score = F.col("score")
    return findings.filter(score >= threshold if inclusive else score > threshold)
