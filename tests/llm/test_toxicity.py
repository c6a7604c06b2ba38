import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import collected, documents, odd_rows
from spanveil.llm import toxicity as T
from spanveil.llm.queries import op3_toxicity, remainder, table
from spanveil.llm.toxicity import toxicity_scores

LABELS = "doc_id long, quality int, toxic int"


def made_up(n, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(40)] + (rng.choices(["vile", "nasty,", "Brute"], k=3) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_finds_held_out_toxic_texts(spark):
    rows, labels = made_up(600)
    got = toxicity_scores(documents(spark, rows), spark.createDataFrame(labels, LABELS), remainder("doc_id", 5) == 0).collect()
    held = [r for r in got if r["held_out"]]
    truth = {i: t for i, _, t in labels}
    assert sum(r["predicted"] != truth[r["doc_id"]] for r in held) <= 0.02 * len(held)
    assert sum((r["score"] - truth[r["doc_id"]]) ** 2 for r in held) / len(held) < 0.03
    assert all(r["doc_id"] not in {e["doc_id"] for e in r["evidence"]} for r in got)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = made_up(200)
    frame = lambda x: spark.createDataFrame(x, LABELS)
    held = remainder("doc_id", 5) == 0
    one = toxicity_scores(documents(spark, rows), frame(labels), held)
    is_held = {r["doc_id"] for r in one.filter("held_out").collect()}
    two = toxicity_scores(documents(spark, rows), frame([(i, q, 1 - t if i in is_held else t) for i, q, t in labels]), held)
    assert is_held and collected(one, "doc_id", "score") == collected(two, "doc_id", "score")


def test_held_out_accuracy_on_the_table(spark, sf_dir):
    found = op3_toxicity(spark, "/root/testdata/sf0.01")
    truth = table(spark, "/root/testdata/sf0.01", "labels")
    wrong = found.join(truth, "doc_id").filter("held_out").agg(
        F.avg((F.col("predicted") != F.col("toxic")).cast("int")), F.avg("toxic")).first()
    assert wrong[0] < 0.6 * wrong[1]


def test_neighbours_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    n_terms, idf = 60, rng.random(60) + 0.5
    vectors = []
    for _ in range(500):
        own = np.sort(rng.choice(n_terms, rng.integers(0, 9), replace=False))
        vectors.append((own, T.unit(own, rng.integers(1, 5, len(own)).astype(float), idf)))
    index = T.BlockIndex(vectors, np.arange(500), np.zeros(500), n_terms)
    dense = np.zeros((500, n_terms))
    for i, (own, w) in enumerate(vectors):
        dense[i, own] = w
    for i in range(0, 500, 7):
        own, w = vectors[i]
        similar = dense @ dense[i]
        similar[i] = 0
        want = np.argsort(-np.round(similar, 12), kind="stable")[:10]
        want = want[similar[want] > 0]
        best, found = index.nearest(own, w, 10, i)
        assert best.tolist() == (want.tolist() if len(own) else [])
        assert found == pytest.approx(similar[best])


def test_equal_texts_score_alike_whatever_their_ids(spark):
    rows, labels = made_up(150)
    twice = rows + [(i + 10_000, *rest) for i, *rest in rows]
    # Some copies are labelled too, also against each other.
    labels = labels + [(i + 10_000, 1, 1 - t if i % 7 == 0 else t) for i, _, t in labels[::3]]
    got = toxicity_scores(documents(spark, twice), spark.createDataFrame(labels, LABELS), remainder("doc_id", 5) == 0).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert all(score[i] == score[i + 10_000] for i, *_ in rows)
    text = {i: t for i, t, *_ in twice}
    assert all(text[e["doc_id"]] != text[r["doc_id"]] for r in got for e in r["evidence"])


def test_odd_rows_labels_and_empty_tables(spark):
    rows, labels = made_up(100)
    rows = [(i + 1000, *rest) for i, *rest in rows] + odd_rows()
    labels = [(i + 1000, q, t) for i, q, t in labels] + [(None, 1, 1), (1000, None, None), (1000, 1, 0), (777, 1, 1), (5, 0, 0)]
    got = toxicity_scores(documents(spark, rows, clashing=True), spark.createDataFrame(labels, LABELS), F.col("doc_id") == 1001)
    out = got.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    bare = {r["score"] for r in out if r["doc_id"] in (1, 2, 3)}
    assert len(bare) == 1 and bare.pop() < 0.5
    no_labels = toxicity_scores(documents(spark, rows), spark.createDataFrame([], LABELS), F.col("doc_id") == 1)
    assert {r["score"] for r in no_labels.collect()} == {0.0}
    assert toxicity_scores(documents(spark, []), spark.createDataFrame(labels, LABELS), F.col("doc_id") == 1).count() == 0
