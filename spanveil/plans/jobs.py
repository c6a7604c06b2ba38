"""The jobs a user runs: a policy picks the rules, the operators do the rest."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil import fixed_values as V
from spanveil.operators import alerts as A
from spanveil.operators import detect, history, redact, report
from spanveil.operators.policy import Policy
from spanveil.operators.rules import Rule, catalog
from spanveil.sources.text import read_lines


def _in_language(docs: DataFrame, policy: Policy, lang: str | None) -> DataFrame:
    return docs.filter(F.col(lang) == policy.language) if lang else docs


def _rules(policy: Policy, rules: Iterable[Rule] | None, inclusive: bool = False) -> list[Rule]:
    return policy.choose(catalog() if rules is None else rules, inclusive)


def scan(
    docs: DataFrame, policy: Policy = Policy(), rules: Iterable[Rule] | None = None,
    text: str = "text", unit: str = "line", lang: str | None = None,
) -> DataFrame:
    """Finding rows of the texts in the policy's language (``lang`` names that column)."""
    return detect.scan(_in_language(docs, policy, lang), _rules(policy, rules), text, unit)


def scan_files(
    spark: SparkSession, path: str, policy: Policy = Policy(), rules: Iterable[Rule] | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Finding rows of text files of any size, which are read in splits."""
    return detect.scan_lines(read_lines(spark, path, glob), _rules(policy, rules))


def sensitive_lines(
    docs: DataFrame, policy: Policy = Policy(), rules: Iterable[Rule] | None = None,
    text: str = "text", lang: str | None = None,
) -> DataFrame:
    """Lines with findings; scores equal to the threshold count."""
    chosen = _rules(policy, rules, inclusive=True)
    return report.sensitive_lines(_in_language(docs, policy, lang), chosen, text)


def redacted(
    docs: DataFrame, policy: Policy = Policy(), rules: Iterable[Rule] | None = None,
    text: str = "text", mode: str = "placeholder", preserve_newlines: bool = False,
    lang: str | None = None, key: str | None = None,
) -> DataFrame:
    """Redacted texts; the threshold is fixed and does not follow the policy.

    A rule of one language is used when it is the policy's; with ``lang`` (a column) it
    is used on the rows of that language.
    """
    chosen = [
        r for r in (catalog() if rules is None else rules)
        if policy.enabled(r) and (lang or r.lang in (None, policy.language))
    ]
    return redact.redact(docs, chosen, text, mode, preserve_newlines, lang, key=key)


def audit(
    docs: DataFrame, rules: Iterable[Rule] | None = None, text: str = "text", lang: str | None = None
) -> DataFrame:
    """Every non-blank line with every detector, 'Clean' lines included."""
    return report.audit(docs, catalog() if rules is None else rules, text, lang)


def scan_summary(
    docs: DataFrame, policy: Policy = Policy(), rules: Iterable[Rule] | None = None,
    text: str = "text", lang: str | None = None,
) -> DataFrame:
    """Metadata of every text; with ``lang`` rules apply to the rows of their language."""
    chosen = _rules(policy, rules, inclusive=True)
    return report.summarize(docs, chosen, text, lang)


def summary_records(summary: DataFrame, moment: Column, *keys: str) -> DataFrame:
    return history.scan_records(summary, moment, F.lit(V.SCAN_SOURCE), *keys)


def review(records: DataFrame, pointers: DataFrame, by: str) -> DataFrame:
    """Line pairs of each owner's selected (or newest) record, flagged lines marked.

    Records with ``review_lines`` (``redact(with_folds=True)``) keep equal lines beside each
    other where a replaced block took line breaks with it.
    """
    chosen = history.resolve(records, pointers, by)
    pairs = history.aligned_lines if "review_lines" in records.columns else history.side_by_side
    return pairs(chosen, by, "id", "mode", "note")


def history_view(records: DataFrame, limit: int, by: str, tie: str) -> DataFrame:
    """Display rows of each owner's newest records."""
    kept = history.newest(records, limit, [by], "timestamp", tie)
    return history.history_view(kept, by, tie)


def alert_rows(
    docs: DataFrame, pauses: DataFrame, by: str, time: str, spread_by: list[str],
    policy: Policy = Policy(), rules: Iterable[Rule] | None = None, text: str = "text",
    lang: str | None = None,
) -> DataFrame:
    """Alerts of texts with findings, without those raised during a pause."""
    raised = A.alerts(docs, _rules(policy, rules), text, lang)
    return A.suppress_paused(raised, pauses, by, time, spread_by)
