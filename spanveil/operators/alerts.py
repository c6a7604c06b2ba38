"""Alerts: one per text with findings, unless its owner has paused them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil import fixed_values as V
from spanveil.functions.labels import alert_line, percent, severity
from spanveil.operators.detect import line_findings
from spanveil.operators.joins import lookup_join
from spanveil.operators.report import types_of
from spanveil.operators.rules import Rule


def alerts(
    docs: DataFrame, rules: Iterable[Rule], text: str = "text", lang: str | None = None
) -> DataFrame:
    """Texts with at least one finding: keys, count, types, severity and message body."""
    keys = [c for c in docs.columns if c != text]
    # Array first, then a generator over it: texts without findings give no row, and
    # detection runs once.
    found = line_findings(F.col(text), rules, F.col(lang) if lang else None)
    one = F.transform(F.array(found), lambda f: F.struct(f.alias("found")))
    rows = docs.select(*keys, F.inline(F.filter(one, lambda o: F.size(o["found"]) > 0)))
    return alert_columns(rows, keys)


def alert_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Alerts from rows that carry their findings (``found``, not empty)."""
    body = F.array_join(
        F.transform(
            F.col("found"), lambda f: alert_line(f["line_no"], f["entity"], percent(f["score"]))
        ),
        "\n",
    )
    return rows.select(
        *keys,
        F.size("found").alias("span_count"),
        types_of(F.col("found")).alias("types"),
        severity(F.array_max(F.transform("found", lambda f: percent(f["score"])))).alias(
            "severity"
        ),
        F.concat(F.lit(V.ALERT_HEADING + "\n"), body).alias("body"),
    )


def suppress_paused(
    rows: DataFrame, pauses: DataFrame, by: str, time: str, spread_by: list[str],
    seconds: int = V.PAUSE_SECONDS,
) -> DataFrame:
    """Drop alerts raised within ``[pause, pause + seconds)`` of the same owner.

    Time is cut into steps of one pause length.  A pause in an alert's own step hides it
    when it came no later than the alert, so the first of the step decides; a pause in
    the step before hides it while still running, so the last of that step decides.
    Pauses thus shrink to one row per owner and step, and no alert meets more than one.
    """
    length = F.lit(seconds * 1_000_000)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    step = at - F.pmod(at, length)
    none = F.lit(None).cast("long")
    own = F.struct(step.alias("_step"), at.alias("_first"), none.alias("_until"))
    following = F.struct(
        (step + length).alias("_step"), none.alias("_first"), (at + length).alias("_until")
    )
    # Inside a struct a null owner equals a null owner, as in the stream.
    owner = F.struct(F.col(by)).alias("_owner")
    hidden = (
        pauses.select(owner, F.inline(F.array(own, following)))
        .groupBy("_owner", "_step")
        .agg(F.min("_first").alias("_first"), F.max("_until").alias("_until"))
    )
    joined = lookup_join(
        rows.withColumn("_owner", owner).withColumn("_at", at).withColumn("_step", step), hidden,
        ["_owner", "_step"], "left",
        spread_by,
    )
    paused = (F.col("_at") >= F.col("_first")) | (F.col("_at") < F.col("_until"))
    return joined.filter(~F.coalesce(paused, F.lit(False))).select(*rows.columns)
