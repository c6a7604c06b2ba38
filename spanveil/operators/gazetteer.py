"""Dictionary detection for names: people, places, organisations, groups.

Only listed terms are found.  Lines become runs of 1..k words, runs that pass a first look
are looked up by equality, and offsets are worked out only for lines that had a hit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.functions.arrays import empty_array, fold_array, let
from spanveil.functions.labels import percent
from spanveil.functions.lines import explode_lines
from spanveil.functions.spans import place_pieces, regex_pieces
from spanveil.operators.joins import SALTS, lookup_join
from spanveil.session import BROADCAST_ROWS, ensure_checkpoint_dir, is_small

WORD = r"[\p{L}\p{N}]+(?:['#_-][\p{L}\p{N}]+)*"
# Words by which longer terms are looked up.
HEAD = 3
# The first look: bits for each term, bits marked by a term, and the least and most bits of a
# table (at most 32 MB are sent; a fuller table lets more runs pass, and the lookup stays exact).
BITS, PROBES, LEAST, MOST = 16, 4, 1 << 16, 1 << 28
_CHUNK = 1 << 15
_PLACED = "struct<entity:string,start:int,end:int,score:double>"


def words(text: Column) -> Column:
    """Words cut in the text as it is, each then in lower case: lower-casing first could
    move the word edges."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def normalize_dictionary(terms: DataFrame) -> DataFrame:
    """(term, entity, score) with terms as lower-case words and one space between."""
    tokens = words(F.col("term"))
    rows = terms.select(
        F.array_join(tokens, " ").alias("term"), F.size(tokens).alias("_words"), "entity", "score"
    ).filter("term <> ''")
    return rows.groupBy("term", "entity").agg(
        F.max("score").alias("score"), F.max("_words").alias("_words")
    )


def _runs(tokens: Column, lengths: list[int]) -> Column:
    """Every run of one of these numbers of words as struct(at, n, term)."""
    def from_word(tokens: Column, index: Column) -> Column:
        possible = [F.when(index + n <= F.size(tokens), F.lit(n)) for n in lengths]
        return F.transform(
            F.array_compact(F.array(*possible)),
            lambda n: F.struct(
                index.alias("at"), n.alias("n"),
                F.array_join(F.slice(tokens, index + 1, n), " ").alias("term"),
            ),
        )

    if lengths == [1]:
        return F.transform(
            tokens, lambda t, i: F.struct(i.alias("at"), F.lit(1).alias("n"), t.alias("term"))
        )
    return let(
        tokens, lambda bound: F.flatten(F.transform(bound, lambda t, i: from_word(bound, i)))
    )


def _started_runs(tokens: Column, starts: Column) -> Column:
    """The runs that begin at known words, as struct(at, n, term)."""
    def runs(bound: Column) -> Column:
        inside = F.filter(bound["starts"], lambda s: s["at"] + s["n"] <= F.size(bound["tokens"]))
        return F.transform(inside, lambda s: F.struct(
            s["at"].alias("at"), s["n"].alias("n"),
            F.array_join(F.slice(bound["tokens"], s["at"] + 1, s["n"]), " ").alias("term"),
        ))
    return let(F.struct(tokens.alias("tokens"), starts.alias("starts")), runs)


def _place(line: Column, hits: Column) -> Column:
    """Hits (at, n, entity, score) of one line to spans, in position order."""
    placed = F.struct(
        hits.alias("hits"),
        let(regex_pieces(line, WORD), place_pieces).alias("words"),
    )

    def spans(b: Column) -> Column:
        return F.array_sort(
            F.transform(
                b["hits"],
                lambda h: F.struct(
                    F.get(b["words"], h["at"])["start"].alias("start"),
                    (-F.get(b["words"], h["at"] + h["n"] - 1)["end"]).alias("neg_end"),
                    h["entity"].alias("entity"),
                    h["score"].alias("score"),
                ),
            )
        )

    return let(placed, spans)


def _longest(spans: Column) -> Column:
    """Drop spans inside a longer one; input sorted by start, longest first."""
    def step(kept: Column, item: Column) -> tuple[Column, Column]:
        end = -item["neg_end"]
        inside = (end <= kept["end"]) & ~(
            (item["start"] == kept["start"]) & (end == kept["end"])
        )
        one = F.struct(
            item["entity"].alias("entity"), item["start"].alias("start"), end.alias("end"),
            item["score"].alias("score"),
        )
        following = F.struct(
            F.when(inside, kept["start"]).otherwise(item["start"]).alias("start"),
            F.when(inside, kept["end"]).otherwise(end).alias("end"),
        )
        return F.when(inside, empty_array(_PLACED)).otherwise(F.array(one)), following

    nothing = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    return let(spans, lambda s: fold_array(s, nothing, step, _PLACED)["out"])


def first_look(terms: DataFrame) -> Callable[[Column], Column]:
    """Which of the given texts may stand in ``term``, as their places in the array: all that do,
    and few others.  Terms mark bits of a table, which is sent."""
    size = LEAST
    count = terms.count()
    while size < min(BITS * count, MOST):
        size *= 2
    key = F.xxhash64("term")
    step = F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1))
    probes = F.array(*[(key.bitwiseAND(F.lit(size - 1)) + step * i) % size for i in range(PROBES)])
    chunks = terms.select(F.explode(probes).alias("bit")).groupBy(
        F.floor(F.col("bit") / _CHUNK).alias("chunk")
    ).agg(F.bitmap_construct_agg(F.col("bit") % _CHUNK).alias("bits"))
    marks = np.zeros(size // 8, dtype=np.uint8)
    for row in chunks.toLocalIterator():
        start = row["chunk"] * _CHUNK // 8
        marks[start:start + _CHUNK // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    sent = terms.sparkSession.sparkContext.broadcast(marks)

    def look(hashes: pa.Array) -> pa.Array:
        table, mask = sent.value, np.uint64(size - 1)
        keys = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        lengths = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        kept = np.arange(len(keys))
        for i in range(PROBES):
            own = keys[kept]
            bit = ((own & mask) + (own >> np.uint64(32) | np.uint64(1)) * np.uint64(i)) & mask
            kept = kept[(table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        rows = np.searchsorted(ends, kept, side="right")
        offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(lengths)))))
        places = kept - (ends - lengths)[rows]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32()))

    # Nondeterministic only in name: no filter on the outcome repeats it.
    told = F.arrow_udf(look, "array<int>").asNondeterministic()
    return lambda texts: told(F.transform(texts, lambda text: F.xxhash64(text)))


def _candidates(lines: DataFrame, place: list[str], terms: DataFrame, lengths: list[list[int]]) -> DataFrame:
    """Lines with runs of these lengths that pass the first look: place, ``line``, ``runs``; stored, as both the
    lookup and the placing read them."""
    ensure_checkpoint_dir(lines.sparkSession)
    made = let(words(F.col("line")), lambda tokens: F.concat(*[_runs(tokens, some) for some in lengths]))
    runs = lines.select(*place, "line", made.alias("runs"))
    told = runs.select(*place, "line", "runs", first_look(terms)(F.col("runs.term")).alias("kept"))
    return told.filter(F.size("kept") > 0).select(
        *place, "line", F.transform("kept", lambda i: F.get(F.col("runs"), i)).alias("runs")
    ).checkpoint()


def _beside(lines: DataFrame, found: DataFrame, place: list[str]) -> DataFrame:
    """Lines with what was found on them; null keys are keys too."""
    renamed = found.withColumnsRenamed({c: f"_{c}" for c in place})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    return lines.join(renamed, reduce(and_, same))


def _heads(dictionary: DataFrame) -> DataFrame:
    """The first words of the terms of more than ``HEAD`` words, with their lengths."""
    return dictionary.filter(F.col("_words") > HEAD).select(
        F.substring_index("term", " ", HEAD).alias("term"), F.col("_words").alias("_length")
    ).distinct()


def _long_hits(
    lines: DataFrame, place: list[str], dictionary: DataFrame, broadcast_rows: int, salts: int
) -> DataFrame:
    """Hits of the terms of more than ``HEAD`` words: place and ``hit``."""
    long = dictionary.filter(F.col("_words") > HEAD)
    begun = lookup_join(
        lines.select(*place, F.inline("runs")).filter(F.col("n") == HEAD), _heads(dictionary), ["term"], "inner",
        [*place, "at"], broadcast_rows, salts,
    )
    starts = begun.groupBy(*place).agg(
        F.collect_list(F.struct("at", F.col("_length").alias("n"))).alias("starts")
    )
    tried = _beside(lines.drop("runs"), starts, place).select(
        *place, F.inline(_started_runs(words(F.col("line")), F.col("starts")))
    )
    found = lookup_join(tried, long.drop("_words"), ["term"], "inner", [*place, "at"], broadcast_rows, salts)
    return found.select(*place, F.struct("at", "n", "entity", "score").alias("hit"))


def gazetteer_detect(
    docs: DataFrame,
    terms: DataFrame,
    keys: list[str],
    text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Findings for listed terms: keys, line_no, entity, start, end, score, confidence, match.

    ``keys`` identify a text.  A dictionary of checked size goes to every executor and
    the text is not shuffled; a larger one marks bits of a table that is sent, and only runs
    whose bits are marked are joined, salted (position and words only, so the line does not
    travel with them); lines with such runs are stored and fetched again by key.  Hits are
    grouped per line, which a line bounds.

    Only runs of up to ``HEAD`` words are made of every word.  Longer terms are looked up by
    their first ``HEAD`` words, which also tell how long they are; runs of that length are
    made where a term begins so, whatever the longest term is.
    """
    dictionary = normalize_dictionary(terms)
    kinds = dictionary.agg(
        F.array_sort(F.collect_set(F.when(F.col("_words") <= HEAD, F.col("_words")))).alias("short"),
        F.coalesce(F.max("_words") > HEAD, F.lit(False)).alias("long"),
    ).first()
    lines = explode_lines(docs.select(*keys, text), text, skip_blank=True)
    place = [*keys, "line_no"]
    hit = F.struct("at", "n", "entity", "score")
    short = dictionary.filter(F.col("_words") <= HEAD).drop("_words")
    small = is_small(dictionary.drop("_words"), broadcast_rows)
    if small and not kinds["long"]:
        runs = F.inline(_runs(words(F.col("line")), list(kinds["short"]) or [1]))
        found = lines.select(*place, "line", runs).join(F.broadcast(short), "term")
        per_line = found.groupBy(*place).agg(
            F.collect_list(hit).alias("hits"), F.first("line").alias("line")
        )
    else:
        listed, lengths = short.select("term"), [list(kinds["short"]) or [1]]
        if kinds["long"]:
            listed = listed.unionByName(_heads(dictionary).select("term"))
            lengths += [[HEAD]] if HEAD not in lengths[0] else []
        lines = _candidates(lines, place, listed, lengths)
        found = lookup_join(
            lines.select(*place, F.inline("runs")), short, ["term"], "inner", [*place, "at"], broadcast_rows, salts)
        found = found.select(*place, hit.alias("hit"))
        if kinds["long"]:
            found = found.unionByName(_long_hits(lines, place, dictionary, broadcast_rows, salts))
        hits = found.groupBy(*place).agg(F.collect_list("hit").alias("hits"))
        per_line = _beside(lines.drop("runs"), hits, place).select(*place, "line", "hits")
    rows = per_line.select(
        *place, "line", F.inline(_longest(_place(F.col("line"), F.col("hits"))))
    )
    return rows.select(
        *place, "entity", "start", "end", "score", percent(F.col("score")).alias("confidence"),
        F.substring("line", F.col("start") + 1, F.col("end") - F.col("start")).alias("match"),
    )
