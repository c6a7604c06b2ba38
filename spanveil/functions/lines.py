"""Text to numbered lines.

Three line rules are in use: ``python`` (every Unicode line break, one trailing
empty piece dropped), ``lf`` (only ``\\n``) and ``normalized`` (``\\r\\n`` and
``\\r`` count as ``\\n``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import let

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
NON_BLANK = (
    r"[^\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def is_nonblank(text: Column) -> Column:
    """True where Unicode-aware stripping would leave something."""
    return text.rlike(NON_BLANK)


def _pieces(text: Column, mode: str) -> Column:
    if mode == "python":
        return F.split(text, LINE_BREAK, -1)
    if mode == "lf":
        return F.split(text, "\n", -1)
    if mode == "normalized":
        return F.split(normalize_newlines(text), "\n", -1)
    raise ValueError(f"unknown line mode {mode!r}")


def split_lines(text: Column, mode: str = "python") -> Column:
    """Array of lines under the chosen rule."""
    pieces = _pieces(text, mode)
    if mode != "python":
        return pieces
    return let(
        pieces,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p),
    )


def explode_lines(
    docs: DataFrame, text: str = "text", mode: str = "python", skip_blank: bool = False
) -> DataFrame:
    """One row per line: every other column, ``line_no`` from 1, ``line``.

    Numbers are given before blank lines are dropped, so they keep their place.
    """
    # A dropped trailing piece is empty, so skipping blanks covers that rule too.
    lines = _pieces(F.col(text), mode) if skip_blank else split_lines(F.col(text), mode)
    keep = [F.col(c) for c in docs.columns if c != text]
    out = docs.select(*keep, F.posexplode(lines).alias("_pos", "line"))
    if skip_blank:
        out = out.filter(is_nonblank(F.col("line")))
    return out.select(*[c for c in docs.columns if c != text],
                      (F.col("_pos") + 1).alias("line_no"), "line")
