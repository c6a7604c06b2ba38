"""Spans: where a rule matched, which spans overlap, and text put in their place.

Offsets count code points from 0 and are half-open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.arrays import empty_array, fold_array, let, running_total, stretch

SPAN = "struct<entity:string,start:int,end:int,score:double,rule:string,match:string>"


def regex_pieces(text: Column, pattern: str, prefix: str = "") -> Column:
    """``struct<hits, pieces>``: the matches, and each with the gap in front of it.

    ``\\G`` ties each search to the end of the one before, so the pieces follow on
    from each other and offsets are a running sum of their lengths.  (Splitting by the
    pattern would give the gaps too, but compiles the pattern anew for every text.)
    """
    regex = F.lit(f"(?s)\\G.*?{prefix}({pattern})")
    return F.struct(
        F.regexp_extract_all(text, regex, F.lit(1)).alias("hits"),
        F.regexp_extract_all(text, regex, F.lit(0)).alias("pieces"),
    )


def place_pieces(found: Column) -> Column:
    """``regex_pieces`` (a bound variable) to ``array<struct<start,end,match>>``."""
    return F.zip_with(
        found["hits"],
        running_total(F.transform(found["pieces"], F.length)),
        lambda hit, end: F.struct(
            (end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("match")
        ),
    )


def regex_spans(text: Column, pattern: str, prefix: str = "") -> Column:
    """Every match of ``pattern`` as ``array<struct<start,end,match>>``."""
    return let(regex_pieces(text, pattern, prefix), place_pieces)


def span_text(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def sort_spans(spans: Column) -> Column:
    """Order by position, then entity."""
    def placed(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"),
                        s["entity"].alias("entity"), s["score"].alias("score"),
                        s["rule"].alias("rule"), s["match"].alias("match"))

    def named(s: Column) -> Column:
        return F.struct(s["entity"].alias("entity"), s["start"].alias("start"),
                        s["end"].alias("end"), s["score"].alias("score"),
                        s["rule"].alias("rule"), s["match"].alias("match"))

    # Most lines hold one span or none.
    return let(spans, lambda found: F.when(
        F.size(found) > 1, F.transform(F.sort_array(F.transform(found, placed)), named)
    ).otherwise(found))


# Labels compare as (-score, -length, start, entity): the smallest one wins.
_LABEL = "struct<neg_score:double,neg_length:int,start:int,entity:string>"
ISLAND = "struct<start:int,end:int,entity:string,score:double>"


def merge_spans(spans: Column) -> Column:
    """Union of overlapping spans, in order; touching spans stay apart.

    The label of a union is the one with the highest score, then the longest,
    then the earliest, then the first by name.
    """
    items = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.struct(
                    (-s["score"]).alias("neg_score"),
                    (s["start"] - s["end"]).alias("neg_length"),
                    s["start"].alias("start"),
                    s["entity"].alias("entity"),
                ).alias("label"),
            ),
        )
    )
    nothing = F.lit(None).cast(f"struct<start:int,end:int,label:{_LABEL}>")

    def island(group: Column) -> Column:
        return F.struct(
            group["start"].alias("start"),
            group["end"].alias("end"),
            group["label"]["entity"].alias("entity"),
            (-group["label"]["neg_score"]).alias("score"),
        )

    def step(group: Column, item: Column) -> tuple[Column, Column]:
        joins = F.coalesce(item["start"] < group["end"], F.lit(False))
        grown = F.struct(
            group["start"].alias("start"),
            F.greatest(group["end"], item["end"]).alias("end"),
            F.least(group["label"], item["label"]).alias("label"),
        )
        closed = F.when(group.isNotNull() & ~joins, F.array(island(group))).otherwise(
            empty_array(ISLAND)
        )
        return closed, F.when(joins, grown).otherwise(item)

    def finish(state: Column) -> Column:
        rest = F.when(state["carry"].isNotNull(), F.array(island(state["carry"]))).otherwise(
            empty_array(ISLAND)
        )
        return F.concat(state["out"], rest)

    return let(items, lambda i: let(fold_array(i, nothing, step, ISLAND), finish))


def splice(text: Column, spans: Column, render: Callable[[Column, Column], Column]) -> Column:
    """Replace each span with ``render(span, matched text)`` and keep the rest.

    ``spans`` must be sorted and must not overlap.  Taking a substring walks the text from
    its start, so spans are handled in blocks, each cut from its own stretch of the text:
    about the square root of their number makes both walks short.
    """

    def block_size(all_spans: Column) -> Column:
        return F.ceil(F.sqrt(F.size(all_spans))).cast("int")

    def previous_end(all_spans: Column, index: Column) -> Column:
        return F.when(index > 0, F.get(all_spans, index - 1)["end"]).otherwise(F.lit(0))

    def block(all_spans: Column, number: Column) -> Column:
        size = block_size(all_spans)
        part = stretch(all_spans, number, size)
        low = previous_end(all_spans, number * size)
        bound = F.struct(part.alias("part"), low.alias("low"))

        def with_cut(b: Column) -> Column:
            high = F.element_at(b["part"], -1)["end"]
            return F.struct(
                b["part"].alias("part"),
                b["low"].alias("low"),
                F.substring(text, b["low"] + 1, high - b["low"]).alias("cut"),
            )

        def rendered(b: Column) -> Column:
            def one(span: Column, index: Column) -> Column:
                before = F.when(index > 0, F.get(b["part"], index - 1)["end"]).otherwise(b["low"])
                piece = F.substring(b["cut"], before - b["low"] + 1, span["end"] - before)
                gap = span["start"] - before
                return let(piece, lambda p: F.concat(
                    F.substring(p, F.lit(1), gap),
                    render(span, F.substring(p, gap + 1, span["end"] - span["start"])),
                ))

            return F.array_join(F.transform(b["part"], one), "")

        return let(let(bound, with_cut), rendered)

    def whole(all_spans: Column) -> Column:
        last = F.floor((F.size(all_spans) - 1) / block_size(all_spans)).cast("int")
        body = F.array_join(
            F.transform(F.sequence(F.lit(0), last), lambda n: block(all_spans, n)), ""
        )
        tail_from = F.element_at(all_spans, -1)["end"]
        return F.concat(body, F.substring(text, tail_from + 1, F.length(text)))

    return let(spans, lambda s: F.when(F.size(s) > 0, whole(s)).otherwise(text))


_MARK = "\u0001"


def span_lines(text: Column, spans: Column) -> Column:
    """Line number (``\\n`` only, from 1) of each span's start; spans sorted by start.

    A mark goes in at every start and everything but marks and line feeds goes out,
    so the n-th mark stands on the line of the n-th span.
    """
    points = F.transform(spans, lambda s: F.struct(s["start"].alias("start"),
                                                   s["start"].alias("end")))
    clean = F.replace(text, F.lit(_MARK), F.lit(" "))
    marked = F.regexp_replace(
        let(clean, lambda c: splice(c, points, lambda span, hit: F.lit(_MARK))), f"[^\n{_MARK}]+", ""
    )
    runs = F.split(marked, "\n", -1)
    return F.flatten(F.transform(runs, lambda run, i: F.array_repeat(i + 1, F.length(run))))


def affected_lines(text: Column, spans: Column) -> Column:
    """Sorted distinct numbers of the lines in which a span starts."""
    return F.array_distinct(span_lines(text, spans))
