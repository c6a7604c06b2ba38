import random
import re
from itertools import permutations

import numpy as np
from helpers import WORD, collected, documents, duck_rows, odd_rows
from spanveil.llm.filter_audit import counted, filter_audit, merged, outside
from spanveil.llm.queries import SQL, op11_filter_audit

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
           "shapley"]


def failed(rows):
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        out = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
               "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
               "E": doc_id is not None and doc_id > first[t]}
        yield {f for f, bad in out.items() if bad}


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    own = [(r[2] or "", r[0], bad) for r, bad in zip(rows, failed(rows))]
    out = []
    for part in {p for p, _, _ in own}:
        mine, total = [(i, bad) for p, i, bad in own if p == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                removed = [i for i, bad in mine if f in bad and not bad & gone]
                redundant = sum(f in bad and bool(bad & gone) for _, bad in mine)
                gone.add(f)
                total[f] += len(removed)
                steps.append((part, "".join(order), step, sum(not bad & gone for _, bad in mine), len(removed),
                              redundant, sum(bad == {f} for _, bad in mine), sum(i in good for i in removed),
                              sum(i in toxic for i in removed), f))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out, key=repr)


def test_equals_sql(spark, sf_dir):
    names, want = duck_rows(sf_dir, SQL["op11_filter_audit"])
    assert collected(op11_filter_audit(spark, sf_dir), *names) == sorted(want, key=repr)


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows() + [(20 + i, "SHOUT $ " * i, ["en", None, ""][i % 3], "s", 1) for i in range(12)]
    rows += [(60 + i % 4, "a copy of some text", "en", "s", 1) for i in range(30)]
    labels = [(20, 1, 0), (20, 0, 1), (21, 1, None), (60, 1, 1), (63, None, 1), (None, 1, 1), (999, 1, 1)]
    got = filter_audit(documents(spark, rows, clashing=True), spark.createDataFrame(labels, LABELS))
    assert collected(got, *COLUMNS) == brute(rows, labels)


def test_lists_over_several_ranges_and_hot_copies(spark, monkeypatch):
    from spanveil.llm import common, filter_audit as module
    monkeypatch.setattr(module, "RANGE_BITS", 2)
    monkeypatch.setattr(common, "HOT", 5)
    dice = random.Random(3)
    rows = [(i, dice.choice(["x", "X $", "word " * 120, "a b c " * 40, f"own {i}"]), dice.choice(["en", "fr"]), "s", 1)
            for i in range(300)]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 300, 2)]
    got = filter_audit(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    assert collected(got, *COLUMNS) == brute(rows, labels)


def test_empty_tables(spark):
    assert filter_audit(documents(spark, []), spark.createDataFrame([], LABELS)).count() == 0
    got = filter_audit(documents(spark, [(1, "a", "en", "s", 1)]), spark.createDataFrame([], LABELS))
    assert got.count() == 600 and got.filter("good_lost + toxic_lost > 0").count() == 0


def test_own_filters(spark):
    own = {"L": lambda text, _: text == "long", "S": lambda text, w: text == "short"}
    got = filter_audit(documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(["long", "short", "short"])]),
                       spark.createDataFrame([], LABELS), filters=own)
    assert {r["filter_order"] for r in got.collect()} == {"".join(o) for o in permutations("ELS")}
    assert got.filter("filter_order = 'SEL' and step = 1").first()["removed"] == 2


def test_galloping_merges():
    dice = np.random.default_rng(1)
    for high in (1, 5, 50, 4_000, 1_000_000):
        for _ in range(20):
            a = np.unique(dice.integers(0, high, dice.integers(0, 3_000)))
            b = np.unique(dice.integers(0, high, dice.integers(0, 3_000)))
            new = outside(a, b)
            assert new.tolist() == sorted(set(a.tolist()) - set(b.tolist()))
            assert merged(b, new).tolist() == sorted(set(a.tolist()) | set(b.tolist()))


def test_counts_of_no_lists():
    none = np.array([], dtype=np.int64)
    assert counted([none] * 3, none, none) == {}
