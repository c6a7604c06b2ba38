"""Ranked lexical search: the best documents of each query by an integer BM25 score.

Method: documents are packed into blocks that hold, for each term of the queries, a bitmap of
the documents with it and their counts.  For a query, the bitmaps of its terms are laid side
by side and read across, which gives each document the mask of the terms it holds; documents
fall into groups of equal masks.  A mask has a largest possible score from the block's best
count of each of its terms.  Masks are evaluated from the largest such score down, until no
mask that is left can reach the k-th score found.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import UPPER, pick, stored

# A term is a run of ASCII letters and digits and of all characters beyond ASCII.
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(UPPER, UPPER.lower())
# Documents of a block, and bytes of query text whose terms are looked for in one pass.
BLOCK = 8_192
QUERY_BYTES = 4 * 1024 * 1024
# Documents that are scored at once, at least.
STEP = 64
SALTS = 64

BLOCKS = (
    "docs long, tokens long, terms array<int>, frequencies array<int>, ids binary, known binary, lengths binary, "
    "places binary, counts binary"
)


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower() if text.isascii() else text.translate(LOWER))


def block_row(ids: list, lengths: list[int], owners: list[np.ndarray], terms: list[np.ndarray],
              counts: list[np.ndarray]) -> dict:
    """Postings of a block ordered by term, then by document."""
    term = np.concatenate(terms) if terms else np.array([], dtype=np.int32)
    place = np.concatenate(owners) if owners else np.array([], dtype=np.int32)
    order = np.lexsort((place, term))
    own, frequencies = np.unique(term, return_counts=True)
    size = np.array(lengths, dtype=np.int64)
    known = np.array([not pd.isna(i) for i in ids], dtype=np.bool_)
    return {
        "docs": int((size > 0).sum()), "tokens": int(size.sum()), "terms": own, "frequencies": frequencies,
        "ids": np.array([i if k else 0 for i, k in zip(ids, known)], dtype=np.int64).tobytes(),
        "known": known.tobytes(), "lengths": size.tobytes(), "places": place[order].astype(np.int32).tobytes(),
        "counts": (np.concatenate(counts) if counts else np.array([]))[order].astype(np.int64).tobytes(),
    }


def packed(docs: DataFrame, vocabulary: Broadcast, block: int) -> DataFrame:
    """One row per block of up to ``block`` documents, with the postings of the vocabulary."""
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = vocabulary.value.get
        ids, lengths, owners, terms, counts = [], [], [], [], []
        for frame in frames:
            for doc_id, known, text in zip(frame["id"].tolist(), frame["known"].tolist(), frame["text"]):
                own = terms_of(text)
                held = np.array([n for n in map(number, own) if n is not None], dtype=np.int32)
                term, count = np.unique(held, return_counts=True)
                owners.append(np.full(len(term), len(ids), dtype=np.int32))
                terms.append(term)
                counts.append(count)
                ids.append(doc_id if known else None)
                lengths.append(len(own))
                if len(ids) == block:
                    yield pd.DataFrame([block_row(ids, lengths, owners, terms, counts)])
                    ids, lengths, owners, terms, counts = [], [], [], [], []
        if ids:
            yield pd.DataFrame([block_row(ids, lengths, owners, terms, counts)])
    return docs.mapInPandas(pack, BLOCKS)


class Block:
    """A packed block with what each posting adds to a score, for one weight of its term."""

    def __init__(self, row: dict, docs: int, tokens: int):
        self.terms = np.asarray(row["terms"], dtype=np.int64)
        ends = np.cumsum(np.asarray(row["frequencies"], dtype=np.int64))
        self.starts, self.ends = np.concatenate(([0], ends[:-1])), ends
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.known = np.frombuffer(row["known"], dtype=np.bool_)
        self.places = np.frombuffer(row["places"], dtype=np.int32)
        lengths = np.frombuffer(row["lengths"], dtype=np.int64)
        counts = np.frombuffer(row["counts"], dtype=np.int64)
        norms = 75 + 25 * lengths * docs // max(tokens, 1)
        self.adds = 1_000_000_000 * counts // (1_000 * counts + 12 * norms[self.places])
        self.best = np.maximum.reduceat(self.adds, self.starts) if len(self.adds) else self.adds
        self.width = -(-len(self.ids) // 8)
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, at: int) -> np.ndarray:
        if at not in self.bitmaps:
            bits = np.zeros(len(self.ids), dtype=np.uint8)
            bits[self.places[self.starts[at]:self.ends[at]]] = 1
            self.bitmaps[at] = np.packbits(bits)
        return self.bitmaps[at]

    def groups(self, held: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Distinct masks over the terms ``held`` (a row of bits each) and the documents of each mask."""
        maps = np.stack([self.bitmap(at) for at in held.tolist()])
        any_ = np.unpackbits(np.bitwise_or.reduce(maps), count=len(self.ids))
        docs = np.flatnonzero(any_)
        bits = np.unpackbits(maps, axis=1, count=len(self.ids))[:, docs]
        # Words of up to 32 terms, folded into one number per distinct mask.
        number = np.zeros(len(docs), dtype=np.int64)
        for start in range(0, len(bits), 32):
            word = np.zeros(len(docs), dtype=np.int64)
            for bit in bits[start:start + 32]:
                word = word << 1 | bit
            if start:
                word = np.unique(word, return_inverse=True)[1]
                number = np.unique(number, return_inverse=True)[1]
                number = number * (int(word.max()) + 1) + word
            else:
                number = word
        order = np.argsort(number, kind="stable")
        cuts = np.flatnonzero(np.diff(number[order])) + 1
        own = np.split(order, cuts)
        return bits[:, [rows[0] for rows in own]].T, [docs[rows] for rows in own]

    def scores(self, docs: np.ndarray, held: np.ndarray, weights: np.ndarray) -> np.ndarray:
        found = np.zeros(len(docs), dtype=np.int64)
        for at, weight in zip(held.tolist(), weights.tolist()):
            own = self.places[self.starts[at]:self.ends[at]]
            place = np.searchsorted(own, docs)
            place[place == len(own)] = 0
            hit = own[place] == docs
            found[hit] += weight * self.adds[self.starts[at] + place[hit]]
        return found


class Best:
    """The best entries of a query so far: score, then the smaller id, ids before nulls."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 0

    def add(self, block: Block, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(self.least, 1)
        self.rows += [
            (-score, not known, doc_id) for score, known, doc_id in
            zip(scores[good].tolist(), block.known[docs[good]].tolist(), block.ids[docs[good]].tolist())
        ]
        self.rows.sort()
        del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def search_block(block: Block, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds the block's documents that can be among the best; how many were scored.

    ``terms`` are the query's distinct terms, ascending, ``weights`` their weights times
    how often the query has them.
    """
    at = np.searchsorted(block.terms, terms)
    at[at == len(block.terms)] = 0
    here = block.terms[at] == terms if len(block.terms) else np.zeros(len(terms), dtype=np.bool_)
    held, weights = at[here], weights[here]
    if not len(held):
        return 0
    masks, groups = block.groups(held)
    bounds = masks.astype(np.int64) @ (weights * block.best[held])
    scored, wait, waiting = 0, [], 0
    for group in np.argsort(-bounds, kind="stable").tolist():
        if bounds[group] < best.least or bounds[group] == 0:
            break
        wait.append(groups[group])
        waiting += len(groups[group])
        if waiting >= STEP:
            docs = np.concatenate(wait)
            best.add(block, docs, block.scores(docs, held, weights))
            scored, wait, waiting = scored + waiting, [], 0
    if wait:
        docs = np.concatenate(wait)
        best.add(block, docs, block.scores(docs, held, weights))
    return scored + waiting


def found_in(blocks: DataFrame, sent: Broadcast, docs: int, tokens: int, k: int, first: int) -> DataFrame:
    """``query, score, known, id``: the best of each query among the blocks of a task; queries count from ``first``."""
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = sent.value
        best = [Best(k) for _ in queries]
        for frame in frames:
            for row in frame.to_dict("records"):
                block = Block(row, docs, tokens)
                for own, (terms, weights) in zip(best, queries):
                    search_block(block, terms, weights, own)
        out = [(first + q, -score, not unknown, i) for q, own in enumerate(best) for score, unknown, i in own.rows]
        yield pd.DataFrame(out, columns=["query", "score", "known", "id"])
    return blocks.mapInPandas(search, "query int, score long, known boolean, id long")


def query_slices(queries: DataFrame, size: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Ids and terms of the queries, in lists of at most ``size`` bytes of text (or one query)."""
    held, used = [], 0
    for row in queries.toLocalIterator():
        if held and used + len(row["text"]) > size:
            yield held
            held, used = [], 0
        held.append((row["query_id"], terms_of(row["text"])))
        used += len(row["text"])
    if held:
        yield held


def weight(docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * frequency + 1)))


def ranked_search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_col: str = "item_id",
    query_text_col: str = "text",
    k: int = 20,
    block: int = BLOCK,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """One row per query and one of its ``k`` best documents: query id, ``rank``, document id, ``score``.

    Only documents with a score above 0 count; equal scores go by ascending id, null ids
    last.  Terms, weights and scores are whole numbers (see `weight` and `Block`); statistics
    cover all documents with a term.  A term that a query repeats counts each time.  Null and
    empty texts hold no term: such queries return nothing.  Each row of either table stands
    for itself, so repeated documents take a rank each and repeated queries are answered
    each; document ids are whole numbers.  Texts of any length are read whole.  Queries are
    taken in slices of ``query_bytes`` of text, each one pass over the documents, so what is
    sent to the workers is bounded.  Empty tables give an empty result.  Further columns,
    whatever their names, do no harm.
    """
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col).select(
        F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    asked = pick(queries, query_id=query_col, text=query_text_col).filter("text is not null")
    kind = asked.schema["query_id"].dataType
    out, first = None, 0
    for own in query_slices(asked, query_bytes):
        numbers = {t: i for i, t in enumerate(sorted({t for _, terms in own for t in terms}))}
        vocabulary = spark.sparkContext.broadcast(numbers)
        blocks = stored(packed(rows, vocabulary, block), "term-blocks")
        size = blocks.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
        total, tokens = size["docs"] or 0, size["tokens"] or 0
        # One row per term of the slice at most.
        held = blocks.select(F.explode(F.arrays_zip("terms", "frequencies")).alias("t")).groupBy("t.terms").agg(
            F.sum("t.frequencies").alias("n")
        )
        weights = {r["terms"]: weight(total, r["n"]) for r in held.toLocalIterator()}
        wanted = []
        for _, terms in own:
            term, times = np.unique([numbers[t] for t in terms], return_counts=True)
            wanted.append((
                term.astype(np.int64), np.array([weights.get(t, 0) for t in term.tolist()], dtype=np.int64) * times
            ))
        sent = spark.sparkContext.broadcast(wanted)
        names = spark.createDataFrame([(first + i, q) for i, (q, _) in enumerate(own)], f"query int, query_id {kind.simpleString()}")
        found = stored(found_in(blocks, sent, total, tokens, k, first), "found-in-blocks")
        found = found.join(F.broadcast(names), "query")
        out = found if out is None else out.unionByName(found)
        first += len(own)
        vocabulary.unpersist()
    if out is None:
        return spark.createDataFrame([], f"{query_col} {kind.simpleString()}, rank int, {id_col} long, score long")
    order = [F.desc("score"), F.desc("known"), F.asc("id")]
    # Blocks of many tasks meet in parts first.
    part = Window.partitionBy("query_id", "query", "salt").orderBy(*order)
    whole = Window.partitionBy("query_id", "query").orderBy(*order)
    few = out.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn(
        "rank", F.row_number().over(part)
    ).filter(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k).select(
        F.col("query_id").alias(query_col), "rank", F.when(F.col("known"), F.col("id")).alias(id_col), "score"
    )
