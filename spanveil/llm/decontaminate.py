"""Benchmark decontamination: test items found again in training texts.

The test items are the index: an inverted index with BM25 weights, each divided by the
item's own total, so 1 means every term of the item.  Every passage of every text is a
query.  As in block-max WAND, an item is looked at only if the passage holds one of its
heavy terms (the light ones together stay below the threshold) and if the block bound of
its neighbourhood reaches the threshold; then its score is exact.  All items above the
threshold are verified: five-word shingles of the question part and of the answer part
must be there, or an alignment of the part's words, so that one edit does not void a short
part.  A part too short for a shingle counts with the other.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import batches, kept, pick, restored

MARKS = "".join(map(chr, range(0x21, 0x30))) + ":;<=>?@[\\]^_`{|}~«»„“”‘’…¿¡—–"
ENDS = (".", "?", "!", ":", "。", "？", "！")
PASSAGE, STRIDE = 128, 64
# Longer items are indexed in pieces that a passage always holds whole.
PIECE = STRIDE
BLOCK = 8
MEMO = 500_000
# Bytes of item text that one index, and so one broadcast, holds at most.
INDEX_BYTES = 8 * 1024 * 1024
K1, B = 1.2, 0.75


def normal(word: str) -> str:
    return word.strip(MARKS).lower()


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words: the answer is the last sentence or line, else the last quarter."""
    words = [(normal(w), w.endswith(ENDS), i) for i, line in enumerate(text.split("\n")) for w in line.split()]
    words = [w for w in words if w[0]]
    own = [w[0] for w in words]
    for at in range(len(words) - 1, 0, -1):
        if words[at - 1][1] or words[at - 1][2] != words[at][2]:
            break
    else:
        at = len(words) - max(1, len(words) // 4)
    return (own[:at], own[at:]) if at > 0 else (own, [])


def shingles(words: Sequence, k: int) -> set[tuple]:
    k = max(1, min(k, len(words)))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) else set()


def infix_distance(part: list[int], region: list[int]) -> int:
    """Fewest edits of words that turn ``part`` into some stretch of ``region``."""
    full, top = (1 << len(part)) - 1, 1 << len(part) - 1
    places: dict[int, int] = {}
    for i, word in enumerate(part):
        places[word] = places.get(word, 0) | 1 << i
    vp, vn, score, best = full, 0, len(part), len(part)
    for word in region:
        eq = places.get(word, 0)
        x = eq | vn
        d0 = (((eq & vp) + vp) ^ vp) & full | eq
        hp = vn | ~(d0 | vp) & full
        hn = vp & d0
        score += bool(hp & top) - bool(hn & top)
        best = min(best, score)
        hp, hn = hp << 1 & full, hn << 1 & full
        vp = hn | ~(x | hp) & full
        vn = hp & x
    return best


class ItemIndex:
    """Inverted index of test items with normalised BM25 weights and block bounds."""

    def __init__(self, items: list[tuple[object, str]], frequencies: dict[str, int], n_items: int, mean: float,
                 threshold: float, k: int):
        parts = [(item, *split_item(text)) for item, text in items]
        parts = [(item, q, a) for item, q, a in parts if q or a]
        self.items = [item for item, _, _ in parts]
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(w for _, q, a in parts for w in (*q, *a)))}
        self.threshold, self.k = threshold, k
        self.parts = [([self.terms[w] for w in q], [self.terms[w] for w in a]) for _, q, a in parts]
        self.owner: list[int] = []
        entries, self.heavy = [], defaultdict(list)
        idf = {t: np.log(1 + (n_items - frequencies.get(t, 1) + 0.5) / (frequencies.get(t, 1) + 0.5)) for t in self.terms}
        names = list(self.terms)
        for number, (q, a) in enumerate(self.parts):
            words = q + a
            for start in range(0, len(words), PIECE):
                piece = words[start:start + PIECE]
                if start and len(piece) < k:
                    continue
                tf = Counter(piece)
                weight = {t: idf[names[t]] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(piece) / mean)) for t, n in tf.items()}
                total, light = sum(weight.values()), 0.0
                entry = len(self.owner)
                self.owner.append(number)
                for t, w in sorted(weight.items(), key=lambda x: (x[1], x[0])):
                    w /= total
                    entries.append((t, entry, w))
                    # The light terms alone cannot reach the threshold.
                    if light + w < threshold - 1e-9:
                        light += w
                    else:
                        self.heavy[t].append(entry)
        self.weights: list[dict[int, float]] = [{} for _ in self.owner]
        self.block_max: list[dict[int, float]] = [{} for _ in range(-(-len(self.owner) // BLOCK))]
        for t, entry, w in entries:
            self.weights[entry][t] = w
            top = self.block_max[entry // BLOCK]
            top[t] = max(top.get(t, 0.0), w)
        self.is_heavy = np.zeros(len(self.terms) + 1, dtype=bool)
        self.is_heavy[list(self.heavy)] = True
        self.heavy_of: list[list[int]] = [[] for _ in self.owner]
        for t, own in self.heavy.items():
            for entry in own:
                self.heavy_of[entry].append(t)
        # The postings once more, by term, to bound all entries of a text at once.
        entries.sort(key=lambda x: x[0])
        self.posted = np.array([e for _, e, _ in entries], dtype=np.int64)
        self.posted_weight = np.array([w for _, _, w in entries], dtype=np.float64)
        self.posted_from = np.searchsorted(np.array([t for t, _, _ in entries]), np.arange(len(self.terms) + 1))
        # What must be there, in one of the ways: each part, or both as one if one of them is shorter than a shingle.
        ways = [[parts] + [[parts[0] + parts[1]]] * (0 < min(map(len, parts)) < k) for parts in self.parts]
        self.verify = [
            [[(shingles(part, k), min(k, len(part)), part) for part in way if part] for way in own] for own in ways
        ]

    def possible(self, own: np.ndarray) -> np.ndarray:
        """Entries whose score against all words of a text reaches the threshold: no passage of
        the text can score higher."""
        seen = np.zeros(len(self.terms) + 1, dtype=bool)
        seen[own] = True
        present = np.flatnonzero(seen[:-1])
        starts, ends = self.posted_from[present], self.posted_from[present + 1]
        if not len(present):
            return present
        sizes = ends - starts
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        bound = np.bincount(self.posted[at], self.posted_weight[at], minlength=len(self.owner))
        return np.flatnonzero(bound >= self.threshold - 1e-6)

    def retrieved(self, own: np.ndarray, possible: set[int]) -> list[int]:
        """Entries among the possible ones whose score against the passage reaches the threshold."""
        present = np.unique(own)
        present = present[present >= 0]
        asked = {e for t in present[self.is_heavy[present]].tolist() for e in self.heavy[t]} & possible
        if not asked:
            return []
        inside, found, least = set(present.tolist()), [], self.threshold - 1e-9
        open_ = set()
        for block in {e // BLOCK for e in asked}:
            top = self.block_max[block]
            if sum(map(top.__getitem__, top.keys() & inside)) >= least:
                open_.add(block)
        for entry in sorted(asked):
            if entry // BLOCK in open_:
                weight = self.weights[entry]
                if sum(map(weight.__getitem__, weight.keys() & inside)) >= least:
                    found.append(entry)
        return found

    def overlaps(self, item: int, region: list[int], least: float) -> bool:
        """Whether every part of the item is in the region, up to ``least`` of its shingles or words."""
        seen: dict[int, set[tuple]] = {}
        words = set(region)

        def held(wanted: set[tuple], size: int, part: list[int]) -> bool:
            if size not in seen:
                seen[size] = {tuple(region[i:i + size]) for i in range(len(region) - size + 1)}
            if len(wanted & seen[size]) >= least * len(wanted) - 1e-9:
                return True
            edits = int((1 - least) * len(part) + 1e-9)
            # Each word of the part that the region does not hold is an edit.
            return edits > 0 and sum(w not in words for w in part) <= edits and infix_distance(part, region) <= edits

        return any(all(held(*part) for part in way) for way in self.verify[item])

    def found(self, own: np.ndarray, least: float) -> list[int]:
        """Numbers of the items that a text (term numbers, -1 for other words) holds."""
        possible = set(self.possible(own).tolist())
        if not possible:
            return []
        asked = np.zeros(len(self.terms) + 1, dtype=bool)
        asked[[t for entry in possible for t in self.heavy_of[entry]]] = True
        places = np.flatnonzero(asked[own])
        at = places // STRIDE
        starts = np.unique(np.concatenate((at, np.maximum(at - 1, 0))))
        out: set[int] = set()
        for start in (starts * STRIDE).tolist():
            for entry in self.retrieved(own[start:start + PASSAGE], possible):
                item = self.owner[entry]
                if item not in out:
                    size = sum(map(len, self.parts[item]))
                    region = own[max(0, start - size):start + PASSAGE + size].tolist()
                    if self.overlaps(item, region, least):
                        out.add(item)
        return sorted(out)


class TermNumbers(dict):
    """Word of a text -> its number in the index, -1 if no item has it, -2 if it is only marks."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> int:
        own = normal(word)
        found = self.terms.get(own, -1) if own else -2
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        found = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return found[found != -2]


def item_terms(items: DataFrame) -> DataFrame:
    """``term, n``: items that hold a term, counted over all of them."""
    def list_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 256):
            own = [t for text in frame["text"] for t in {normal(w) for w in text.split()} if t]
            yield pd.DataFrame({"term": own})
    return items.select("text").mapInPandas(list_terms, "term string").groupBy("term").agg(F.count("*").alias("n"))


def slices(items: DataFrame, size: int) -> Iterator[list[tuple[object, str]]]:
    """The items in lists of at most ``size`` bytes of text, one list at a time on the driver."""
    held, used = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if held and used + len(row["text"]) > size:
            yield held
            held, used = [], 0
        held.append((row["item_id"], row["text"]))
        used += len(row["text"])
    if held:
        yield held


def searcher(sent: Broadcast, kind: str, least: float) -> Callable[..., Column]:
    @F.pandas_udf(f"array<{kind}>")
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = sent.value
        numbers = TermNumbers(index.terms)
        for part in parts:
            yield pd.Series([[index.items[i] for i in index.found(numbers.of(t), least)] for t in part])
    return search


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = 0.6,
    least: float = 0.8,
    k: int = 5,
    index_bytes: int = INDEX_BYTES,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, kept columns, ``items, contaminated``.

    ``items`` lists the ids of the test items whose question and answer the text holds
    (``least`` of the ``k``-word shingles of each, or all but the rest of its words by
    edits, in one stretch), ascending.  If a part has fewer than ``k`` words, both
    may also count as one.  Words
    are compared without outer marks and in lower case.  Null and empty items and texts
    match nothing; an item without a sentence end has its last quarter as answer; an
    item of one word has no answer part.  Repeated items are listed once, items without
    id never.  A benchmark of more than ``index_bytes`` is taken in several indexes, one
    pass each.  Texts are searched whole; repeated rows get the same result; an empty
    table gives an empty result, an empty benchmark no finding.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, **kept(keep)).withColumn("text", F.coalesce("text", F.lit("")))
    items = pick(benchmark, item_id=item_col, text=item_text_col).dropna().distinct()
    kind = items.schema["item_id"].dataType.simpleString()
    frequencies = item_terms(items).cache()
    size = items.agg(F.count("*"), F.avg(F.size(F.split("text", r"\s+")))).first()
    context = rows.sparkSession.sparkContext
    out = rows.withColumn("items", F.array().cast(f"array<{kind}>"))
    for own in slices(items, index_bytes):
        wanted = {normal(w) for _, text in own for w in text.split()}
        counts = {r["term"]: r["n"] for r in frequencies.toLocalIterator() if r["term"] in wanted}
        index = context.broadcast(ItemIndex(own, counts, size[0], min(size[1], PIECE), threshold, k))
        out = out.withColumn("items", F.array_union("items", searcher(index, kind, least)("text")))
    frequencies.unpersist()
    return out.select(
        F.col("doc_id").alias(id_col), *restored(keep), F.array_sort("items").alias("items"),
        (F.size("items") > 0).alias("contaminated"),
    )
