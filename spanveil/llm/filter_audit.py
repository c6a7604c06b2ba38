"""Audit of text filters: what each removes alone, after others, and on average over all orders.

Method: every filter has one sorted posting list of failing rows per part and range of row
numbers.  Unions and differences of these lists come from merges that gallop through the
longer list, range by range; their sizes are summed over the ranges.  What a filter removes
after the set S of others is the size of (its list minus the union of S), so the counts of
all 2^n sets hold those of all n! orders.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import pick, spread_join, stored, words

# Rows of a range have the same row number but for so many low bits: a list holds at most 65,536.
RANGE_BITS = 16
# Ids that gallop together.
STEP = 512
# Cells of the summed counts: sets times eight plus filter, then these.
SHAPLEY, UNION, ROWS = 10_000, 20_000, 30_000


def text_filters(
    min_words: int = 100, least_distinct: int = 80, most_capitals: int = 10, marks: str = "[#$%&*|]"
) -> dict[str, Callable[[Column, Column], Column]]:
    """Failure conditions over a text and its words, by letter."""
    return {
        "A": lambda text, own: F.size(own) < min_words,
        "B": lambda text, own: 100 * F.size(F.array_distinct(own)) < least_distinct * F.size(own),
        "C": lambda text, own: 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
        > most_capitals * F.char_length(text),
        "D": lambda text, own: text.rlike(marks),
    }


def outside(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The ids that are not in the other list; both ascending.

    A step of ids doubles its reach in the other list until that passes the last of them,
    so runs of the other list without partners are skipped.
    """
    if not len(ids) or not len(other):
        return ids
    rest, low = [], 0
    for start in range(0, len(ids), STEP):
        part = ids[start:start + STEP]
        reach = 1
        while low + reach < len(other) and other[low + reach] <= part[-1]:
            reach *= 2
        window = other[low:low + reach + 1]
        at = np.searchsorted(window, part)
        there = at < len(window)
        there[there] = window[at[there]] == part[there]
        rest.append(part[~there])
        low += int(at[-1])
        if low >= len(other):
            rest.append(ids[start + STEP:])
            break
    return np.concatenate(rest)


def merged(ids: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Union of two ascending lists without common ids."""
    return np.insert(ids, np.searchsorted(ids, more), more) if len(more) else ids


def counted(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> dict[int, tuple[int, int, int]]:
    """Cells ``number -> (rows, good rows, toxic rows)`` of one part and range."""
    n = len(lists)
    unions: dict[int, np.ndarray] = {0: np.array([], dtype=np.int64)}
    cells: dict[int, tuple[int, int, int]] = {}
    shapley = [0] * n
    for own in range(2**n):
        for f in range(n):
            if own >> f & 1:
                continue
            new = outside(lists[f], unions[own])
            if own | 1 << f not in unions:
                unions[own | 1 << f] = merged(unions[own], new)
            if len(new):
                cells[own * 8 + f] = (
                    len(new), len(new) - len(outside(new, good)), len(new) - len(outside(new, toxic))
                )
            before = own.bit_count()
            shapley[f] += factorial(before) * factorial(n - 1 - before) * len(new)
    cells |= {SHAPLEY + f: (shapley[f], 0, 0) for f in range(n)}
    cells |= {UNION + own: (len(ids), 0, 0) for own, ids in unions.items()}
    return {cell: counts for cell, counts in cells.items() if counts[0]}


def posting_lists(rows: DataFrame, names: list[str]) -> DataFrame:
    """``part, id_range, n`` and per filter, ``good`` and ``toxic`` the ascending row numbers."""
    return rows.groupBy("part", F.shiftright("row", RANGE_BITS).alias("id_range")).agg(
        F.count("*").alias("n"),
        *[F.array_sort(F.collect_list(F.when(F.col(c), F.col("row")))).alias(c) for c in [*names, "good", "toxic"]],
    )


def audit_cells(lists: DataFrame, names: list[str]) -> DataFrame:
    """``part, cell`` and the counts of the cell, of each range."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                own = [np.asarray(row[c], dtype=np.int64) for c in [*names, "good", "toxic"]]
                cells = {ROWS: (row["n"], 0, 0)} | counted(own[:-2], *own[-2:])
                out += [(row["part"], cell, *counts) for cell, counts in cells.items()]
            yield pd.DataFrame(out, columns=["part", "cell", "size", "good", "toxic"])
    return lists.mapInPandas(count, "part string, cell int, size long, good long, toxic long")


def steps_of(names: list[str]) -> Column:
    """All steps of all orders with the cells that hold their counts, as one constant array."""
    every, found = 2 ** len(names) - 1, []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            found.append({
                "filter_order": "".join(names[i] for i in order), "step": step, "removed": before * 8 + f,
                "all": UNION + (before | 1 << f), "alone": f, "last": (every ^ 1 << f) * 8 + f, "shapley": SHAPLEY + f,
            })
            before |= 1 << f
    schema = "array<struct<filter_order:string,step:int,removed:int,all:int,alone:int,last:int,shapley:int>>"
    return F.from_json(F.lit(json.dumps(found)), schema)


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    filters: Mapping[str, Callable[[Column, Column], Column]] | None = None,
    copies: str = "E",
) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of the step.

    Columns: ``part, filter_order, step`` and as long numbers ``kept`` (rows left after the
    step), ``removed`` (rows it takes), ``redundant`` (rows that fail it and were gone
    before), ``unique_fails`` (rows that fail nothing else), ``good_lost`` and
    ``toxic_lost`` (removed rows whose id has a label row with quality or toxic 1),
    ``shapley`` (rows it removes, summed over all orders).

    ``filters`` (`text_filters` unless given; at most seven) are tried on whole texts; the
    filter ``copies`` fails rows whose text equals one with a smaller id anywhere in the
    table.  Null texts count as empty, a null part as the empty one.  Rows are told apart by
    their place in the table, so repeated rows count each, and copies with the same id are
    no copies of each other; rows without id never fail ``copies``, make no other row fail
    it and have no label.  Texts of any length are read whole.  A label row counts where its
    value is 1, others and nulls not.  An empty table gives an empty result, empty labels
    give zeros.  Further columns, whatever their names, do no harm.
    """
    own = dict(text_filters() if filters is None else filters)
    names = sorted([*own, copies])
    rows = pick(docs, id=id_col, text=text_col, part=part_col).select(
        "id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    facts = stored(
        rows.withColumn("words", words(F.col("text"))).select(
            F.monotonically_increasing_id().alias("row"), "id", "part",
            F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
            *[fails(F.col("text"), F.col("words")).alias(name) for name, fails in own.items()],
        ), "filter-facts",
    )
    first = stored(
        facts.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1 and first_id is not null"), "first-copies",
    )
    marked = spread_join(facts, first, "digest", facts.count()).withColumn(
        copies, F.coalesce(F.col("id") > F.col("first_id"), F.lit(False))
    )
    marks = pick(labels, id="doc_id", quality="quality", toxic="toxic").groupBy("id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    labelled = marked.join(marks, "id", "left")
    cells = stored(audit_cells(posting_lists(labelled, names), names), "audit-cells")
    sums = cells.groupBy("part", "cell").agg(
        F.sum("size").alias("size"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    # A part has some hundred cells at most.
    parts = sums.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("cell", F.struct("size", "good", "toxic")))).alias("cells")
    )
    each = parts.select("part", "cells", F.explode(steps_of(names)).alias("at"))

    def of(cell: str, count: str = "size") -> Column:
        return F.coalesce(F.try_element_at("cells", F.col(f"at.{cell}"))[count], F.lit(0))

    return each.select(
        "part", "at.filter_order", "at.step",
        (F.element_at("cells", F.lit(ROWS))["size"] - of("all")).alias("kept"),
        of("removed").alias("removed"),
        (of("alone") - of("removed")).alias("redundant"),
        of("last").alias("unique_fails"),
        of("removed", "good").alias("good_lost"),
        of("removed", "toxic").alias("toxic_lost"),
        of("shapley").alias("shapley"),
    )
