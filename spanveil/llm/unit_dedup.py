"""Substring dedup by hashing lines, paragraphs or sentences.

Units are normalised and hashed, digests are grouped over all documents, the earliest
occurrence stays and the others go, with their offsets in the original text.  A repeated
unit goes only as part of a stretch of repeated units of ``least_words`` words, so short
phrases that many texts have by nature stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import cut, kept, pick, restored, stored

# A unit starts with a character that is not white space.  A sentence is the part of a
# line up to an end mark before white space.
UNITS = {
    "line": re.compile(r"\S[^\n]*"),
    "paragraph": re.compile(r"\S(?:[^\n]|\n(?!\s*\n))*"),
    "sentence": re.compile(r"\S[^\n]*?(?:[.!?…]+(?=\s)|(?=\n)|\Z)"),
}


def normal_words(unit: str) -> list[str]:
    return unit.lower().split()


def unit_digests(text: str, unit: str) -> list[bytes]:
    return [
        xxhash.xxh3_128_digest(" ".join(normal_words(m.group())).encode()) for m in UNITS[unit].finditer(text)
    ]


def without(text: str, repeated: list[int], unit: str, least_words: int) -> tuple[str, int, int, list[dict[str, int]]]:
    """The text without its repeated stretches: text, units, units gone, spans gone."""
    spans = [m.span() for m in UNITS[unit].finditer(text)]
    again, gone, run = set(repeated), [], []

    def close() -> None:
        if run and sum(len(normal_words(text[slice(*spans[i])])) for i in run) >= least_words:
            gone.append((run[0], run[-1]))
        run.clear()

    for i in range(len(spans)):
        if i in again:
            run.append(i)
        else:
            close()
    close()
    kept_text, at, cuts = [], 0, []
    for first, last in gone:
        start = spans[first][0]
        end = spans[last + 1][0] if last + 1 < len(spans) else len(text)
        kept_text.append(text[at:start])
        cuts.append({"start": start, "end": end})
        at = end
    kept_text.append(text[at:])
    return "".join(kept_text), len(spans), sum(b - a + 1 for a, b in gone), cuts


def drop_repeated_units(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rank_col: str | None = None,
    unit: str = "sentence",
    least_words: int = 20,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, kept columns, ``text, n_units, n_removed, removed``.

    Occurrences rank by ``rank_col`` (the id if not given, nulls last), then id, then
    place in the text; the first stays everywhere.  ``removed`` lists the spans that went, in
    code points of the original text, half-open.  Units are compared by their words in
    lower case.  A null or empty text has no units.  A document is an id with its text
    and rank: repeated rows are one document and get the same result.  An empty table
    gives an empty result.  Texts of any length are handled whole.
    """
    ranked = pick(docs, doc_id=id_col, text=text_col, rank=rank_col or id_col, **kept(keep)).withColumn(
        "text", F.coalesce("text", F.lit(""))
    )
    content = F.xxhash64("text").alias("content")
    rows = ranked.select("*", content)

    @F.pandas_udf("array<binary>")
    def digests(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([unit_digests(t, unit) for t in part])

    place = F.struct(
        F.col("rank").isNull().alias("unranked"), "rank", F.col("doc_id").isNull().alias("unnamed"), "doc_id",
        "content", "pos",
    )
    units = rows.select("rank", "doc_id", "content", F.posexplode(digests("text")).alias("pos", "unit"))
    firsts = units.groupBy("unit").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    # Stored, so that the join has an exchange on both sides and a hot unit can be split.
    firsts = cut(firsts.select("unit", "first"))
    again = units.withColumn("place", place).join(firsts, "unit").filter(
        F.col("place") != F.col("first")
    )
    found = stored(again.groupBy("rank", "doc_id", "content").agg(F.collect_set("pos").alias("repeated")), "repeated")

    @F.pandas_udf("text string, n_units long, n_removed long, removed array<struct<start:long,end:long>>")
    def cut_out(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, repeated in parts:
            yield pd.DataFrame(
                [without(t, [] if r is None else list(r), unit, least_words) for t, r in zip(texts, repeated, strict=True)],
                columns=["text", "n_units", "n_removed", "removed"],
            )

    same = (
        rows["content"].eqNullSafe(found["content"]) & rows["doc_id"].eqNullSafe(found["doc_id"])
        & rows["rank"].eqNullSafe(found["rank"])
    )
    joined = rows.join(found.select("content", "doc_id", "rank", "repeated"), same, "left").select(
        rows["*"], found["repeated"]
    )
    return joined.withColumn("out", cut_out("text", "repeated")).select(
        F.col("doc_id").alias(id_col), *restored(keep), "out.text", "out.n_units", "out.n_removed", "out.removed",
    )
