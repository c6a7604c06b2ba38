import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import WORD, collected, documents, odd_rows
from spanveil.llm import mixing
from spanveil.llm.mixing import by_code_point, mix
from spanveil.llm.queries import op6_mixing, table


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """source -> words -> target, by sharing the excess again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), share * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


def size(text):
    return len(WORD.findall(text or ""))


def test_targets_and_totals(spark, sf_dir):
    texts = {r["doc_id"]: r for r in table(spark, sf_dir, "documents").collect()}
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in texts.values():
        sizes[r["source"]] += size(r["text"])
        largest[r["source"]] = max(largest[r["source"]], size(r["text"]))
    want, taken = brute_targets(sizes), defaultdict(int)
    rows = op6_mixing(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        source = texts[r["doc_id"]]["source"]
        assert r["size"] == size(texts[r["doc_id"]]["text"]) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for source, target in want.items():
        # Whole copies: a source of ten documents can miss by half of its largest.
        assert abs(taken[source] - target) <= max(0.02 * target, largest[source] / 2 + 1)
    assert collected(op6_mixing(spark, sf_dir), "doc_id", "taken") == collected(op6_mixing(spark, sf_dir), "doc_id", "taken")


def test_rates_are_the_exponential_tilt(spark):
    """The lambda of the distributed Newton steps is the root that bisection finds."""
    sizes = [3, 10, 40, 41, 100]
    classes = spark.createDataFrame([(0, s, 2) for s in sizes], "rank long, size long, n long")
    total, mean = 2.0 * sum(sizes), sum(sizes) / len(sizes)
    for target in (0.3 * total, total, 1.7 * total):
        sources = spark.createDataFrame([(0, target, total, mean)], "rank long, target double, source_size double, mean double")
        found = mixing.solved(classes, sources, 2).first()["lambda"]
        low, high = -200.0, 200.0
        for _ in range(200):
            middle = (low + high) / 2
            mass = sum(2 * s * 2 / (1 + math.exp(-max(min(middle * s / mean, 600), -600))) for s in sizes)
            low, high = (middle, high) if mass < target else (low, middle)
        assert found == pytest.approx(low, abs=0.02)


def test_odd_rows(spark):
    rows = odd_rows()
    got = mix(documents(spark, rows, clashing=True), keep=["lang"])
    assert collected(got, "doc_id", "size") == sorted(((r[0], size(r[1])) for r in rows), key=repr)
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in got.collect())
    assert mix(documents(spark, [])).count() == 0
    only_empty = mix(documents(spark, [(1, None, None, None, None), (2, "", None, "a", None)]))
    assert collected(only_empty, "taken", "target") == [(0, 0.0), (0, 0.0)]


def test_sources_rank_by_code_point(spark):
    names = ["b", "a", "Z", "é", None, "\U0001F642", "￮", ""]
    df = spark.createDataFrame([(n,) for n in names], "source string")
    got = {r["source"]: r["rank"] for r in by_code_point(df).collect()}
    assert got == {n: i for i, n in enumerate(["", "Z", "a", "b", "é", "￮", "\U0001F642", None])}


def test_one_class_larger_than_a_cell(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 10)
    rows = [(i, "one two three", "en", "hot" if i % 3 else "cold", 1) for i in range(200)]
    taken = mix(documents(spark, rows)).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 3 for r in taken)
