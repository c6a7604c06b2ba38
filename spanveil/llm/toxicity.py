"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded, documented sample of labelled rows becomes the index; its terms (words and
their beginnings) are those that a chi-square test ties to the label.  Document
frequencies are counted over all documents.  Neighbours come from an inverted index cut
into blocks of examples with the largest weight of each term per block: blocks are
scored from the highest bound down, and a block is left out only when its bound is
below the k-th similarity found, so the neighbours are exact.  Votes weigh by distance
and are calibrated on the examples themselves, each without its own label.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from spanveil.llm.common import batches, kept, pick, restored, stored

MARKS = "".join(map(chr, range(0x21, 0x30))) + ":;<=>?@[\\]^_`{|}~«»„“”‘’…¿¡—–"
STARTS = (4, 5)
BLOCK = 64
ROWS = 512
MEMO = 500_000
SLACK = 1e-9


def terms(word: bytes) -> tuple[str, ...]:
    """A word without outer marks in lower case, and the beginnings of longer words."""
    own = word.decode().strip(MARKS).lower()
    return (own, *(f"{own[:n]}*" for n in STARTS if len(own) > n)) if own else ()


class Features(dict):
    """Word (bytes) -> numbers of the selected terms it holds."""

    def __init__(self, selected: dict[str, int]):
        super().__init__()
        self.selected = selected

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(self.selected[t] for t in terms(word) if t in self.selected)
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        seen = Counter(f for w in text.encode().lower().split() for f in self[w])
        own = np.fromiter(sorted(seen), dtype=np.int64, count=len(seen))
        return own, np.fromiter((seen[f] for f in own.tolist()), dtype=np.float64, count=len(seen))


def unit(own: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weight = (1 + np.log(tf)) * idf[own]
    return weight / np.sqrt((weight * weight).sum()) if len(own) else weight


class BlockIndex:
    """Inverted index of unit vectors; postings of a term are cut by blocks of examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray, labels: np.ndarray, n_terms: int):
        self.n, self.names, self.labels = len(vectors), names, labels
        self.blocks = -(-self.n // BLOCK)
        term = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)])
        example = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors])
        weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        cell = term[order] * self.blocks + self.example // BLOCK
        self.starts = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))
        self.bound = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.bound, cell, self.weight)
        self.bound = self.bound.reshape(n_terms, self.blocks)

    def scored(self, own: np.ndarray, weight: np.ndarray, blocks: np.ndarray, into: np.ndarray) -> None:
        """Adds up the exact similarities of the examples in ``blocks``."""
        cells = (own[:, None] * self.blocks + blocks[None, :]).ravel()
        start, n = self.starts[cells], self.starts[cells + 1] - self.starts[cells]
        total = int(n.sum())
        if total:
            at = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
            by = np.repeat(np.repeat(weight, len(blocks)), n)
            into += np.bincount(self.example[at], weights=self.weight[at] * by, minlength=self.n)

    def nearest(self, own: np.ndarray, weight: np.ndarray, k: int, name: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar examples but the document itself; ties by position."""
        if not len(own) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        bounds = weight @ self.bound[own]
        order = np.argsort(-bounds, kind="stable")
        similar, done, step = np.zeros(self.n), 0, 2
        while done < self.blocks:
            more = order[done:done + step]
            more = more[bounds[more] > 0]
            if not len(more):
                break
            self.scored(own, weight, more, similar)
            done, step = done + len(more), step * 2
            valid = np.where(self.names == name, 0.0, similar)
            kth = np.partition(valid, -k)[-k] if self.n >= k else 0.0
            if done < self.blocks and kth > bounds[order[done]] + SLACK:
                break
        similar[self.names == name] = 0.0
        best = np.argsort(-np.round(similar, 12), kind="stable")[:k]
        best = best[similar[best] > 0]
        return best, similar[best]


def vote(index: BlockIndex, best: np.ndarray, similar: np.ndarray, prior: float) -> float:
    """Share of label 1 among the neighbours by nearness, drawn to the prior.

    A weight falls with the distance; neighbours that share little say less than the prior.
    """
    weight = similar * similar / (1.05 - np.minimum(similar, 1.0))
    return float((weight @ index.labels[best] + prior) / (weight.sum() + 1.0))


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the votes (ridge, Newton)."""
    a, b = 1.0, 0.0
    if not len(x):
        return a, b
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (p - y) * x).sum() + 0.1 * (a - 1), (weight * (p - y)).sum() + 0.1 * b])
        h = weight * p * (1 - p)
        hessian = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hessian, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def name_of(text: str) -> int:
    """Names an example by its text alone, so equal texts score alike whatever their ids."""
    return xxhash.xxh3_64_intdigest(text) >> 1


def selected_terms(examples: DataFrame, least_chi2: float, max_terms: int) -> list[str]:
    """The terms whose presence goes with the label, strongest first."""
    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 64):
            for text, label in zip(frame["text"], frame["label"], strict=True):
                own = list({t for w in set(text.encode().lower().split()) for t in terms(w)})
                yield pd.DataFrame({"term": own, "label": [label] * len(own)})

    size = examples.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    p, q = F.lit(float(size[0])), F.lit(float(size[1] - size[0]))
    a, b = F.col("pos"), F.col("all") - F.col("pos")
    rest = F.greatest(p + q - F.col("all"), F.lit(0.5))
    chi2 = (p + q) * F.pow(a * q - b * p, 2) / (p * q * F.col("all") * rest)
    if not size[0] or size[0] == size[1]:
        return []
    best = (
        examples.select("text", "label").mapInPandas(found, "term string, label long")
        .groupBy("term").agg(F.sum("label").alias("pos"), F.count("*").alias("all"))
        .filter(F.col("all") >= 3).withColumn("chi2", chi2).filter(F.col("chi2") >= least_chi2)
        .orderBy(F.col("chi2").desc(), "term").limit(max_terms)
    )
    return [row["term"] for row in best.select("term").collect()]


def document_frequencies(docs: DataFrame, selected: dict[str, int]) -> tuple[int, np.ndarray]:
    """Documents, and documents with each selected term, over the whole table."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, n, seen = Features(selected), 0, Counter()
        for frame in batches(frames, ROWS):
            n += len(frame)
            for text in frame["text"]:
                seen.update({f for w in text.encode().lower().split() for f in features[w]})
        yield pd.DataFrame({"term": [-1, *seen.keys()], "n": [n, *seen.values()]})

    sums = docs.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequencies = np.zeros(len(selected) + 1)
    for row in sums.collect():
        frequencies[row["term"]] = row["n"]
    return int(frequencies[-1]), frequencies[:-1]


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_examples: int = 4_000,
    max_terms: int = 4_096,
    least_chi2: float = 30.0,
    k: int = 15,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, kept columns, ``held_out, score, predicted, evidence``.

    ``held_out`` is an expression over the id column; labels of such ids are not learned
    from.  At most ``max_examples`` labelled rows, half of each label, the first by a
    hash of the id, and ``max_terms`` terms make the model; null labels and labels of
    unknown documents are not used, of repeated labels the largest counts.  ``evidence``
    lists the neighbours (id, similarity, label).  A text without a selected term (an
    empty or null one too) scores by the share of label 1 among those without.  The score is a function
    of the text: examples of the same text are never its neighbours, so equal texts score the
    same under whatever ids.  Texts of any length are read whole; without labels all score 0; an
    empty table gives an empty result.
    """
    rows = pick(docs, **{id_col: id_col}, text=text_col, **kept(keep)).withColumn(
        "held_out", F.coalesce(held_out, F.lit(False))
    ).withColumnRenamed(id_col, "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    learned = (
        pick(labels, **{id_col: id_col}, label=label_col).filter(~F.coalesce(held_out, F.lit(False)))
        .withColumnRenamed(id_col, "doc_id").dropna()
        .groupBy("doc_id").agg((F.max("label") > 0).cast("long").alias("label"))
    )
    sizes = learned.agg(F.count("*"), F.coalesce(F.avg("label"), F.lit(0.0))).first()
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = None
    for label in (0, 1):
        some = learned.filter(F.col("label") == label).orderBy(*order).limit(max_examples // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    examples = stored(
        rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "examples"
    )
    selected = {t: i for i, t in enumerate(selected_terms(examples, least_chi2, max_terms))}
    n_docs, frequencies = document_frequencies(rows, selected)
    idf = np.log((1 + n_docs) / (1 + frequencies)) + 1

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(selected)
        for frame in batches(frames, ROWS):
            found = [features.counts(t) for t in frame["text"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "label": frame["label"],
                "name": [name_of(t) for t in frame["text"]],
                "terms": [own for own, _ in found], "tf": [tf for _, tf in found],
            })

    id_type = rows.schema["doc_id"]
    shape = StructType([
        id_type, StructField("label", LongType()), StructField("name", LongType()),
        StructField("terms", ArrayType(LongType())), StructField("tf", ArrayType(DoubleType())),
    ])
    known = sorted(examples.mapInPandas(vectors, shape).collect(), key=lambda row: (row["name"], str(row["doc_id"])))
    own = [np.asarray(row["terms"], dtype=np.int64) for row in known]
    weight = [unit(o, np.asarray(row["tf"]), idf) for o, row in zip(own, known, strict=True)]
    y = np.array([row["label"] for row in known], dtype=float)
    index = BlockIndex(list(zip(own, weight, strict=True)), np.array([row["name"] for row in known], dtype=np.int64), y, len(selected))
    ids = [row["doc_id"] for row in known]

    # Both labels are sampled alike, so each example stands for its label's share of all labels.
    prior = float(sizes[1])
    share = np.where(y > 0, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9)) if len(y) else y
    votes = np.array([
        logit(vote(index, *index.nearest(o, w, k, int(name)), prior)) if len(o) else np.nan
        for o, w, name in zip(own, weight, index.names, strict=True)
    ])
    with_terms = ~np.isnan(votes)
    slope, offset = calibrated(votes[with_terms], y[with_terms], share[with_terms])
    bare = share[~with_terms]
    empty = float((bare @ y[~with_terms] + prior) / (bare.sum() + 1.0)) if len(y) else prior
    sent = rows.sparkSession.sparkContext.broadcast((selected, idf, index, ids, slope, offset, empty, prior))

    result = StructType([
        StructField("score", DoubleType()),
        StructField("evidence", ArrayType(StructType([
            id_type, StructField("similarity", DoubleType()), StructField("label", LongType()),
        ]))),
    ])

    @F.pandas_udf(result)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        selected, idf, index, ids, slope, offset, empty, prior = sent.value
        features = Features(selected)
        for texts in parts:
            scores, evidence = [], []
            for text in texts:
                own, tf = features.counts(text)
                if not len(own):
                    scores.append(empty)
                    evidence.append([])
                    continue
                best, similar = index.nearest(own, unit(own, tf, idf), k, name_of(text))
                x = slope * logit(vote(index, best, similar, prior)) + offset
                scores.append(1 / (1 + math.exp(-min(max(x, -30), 30))))
                evidence.append([
                    {"doc_id": ids[i], "similarity": float(s), "label": int(index.labels[i])}
                    for i, s in zip(best.tolist(), similar.tolist(), strict=True)
                ])
            yield pd.DataFrame({"score": scores, "evidence": evidence})

    return rows.withColumn("found", score("text")).select(
        F.col("doc_id").alias(id_col), *restored(keep), "held_out", "found.score",
        (F.col("found.score") >= 0.5).cast("int").alias("predicted"), "found.evidence",
    )
