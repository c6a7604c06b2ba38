import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from helpers import LOWER, collected, documents, duck_rows, odd_rows
from pyspark.sql import functions as F
from spanveil.llm.digest_index import PerfectHash, Table, exact_dedup, words_of
from spanveil.llm.queries import SQL, op12_exact_dedup

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
WAYS = [lambda i: F.lit(False), lambda i: F.lit(True), lambda i: i % 3 == 0]


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        name = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[-1], len(ids), n == len(ids) - 1, name) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


def test_equals_sql(spark, sf_dir):
    names, want = duck_rows(sf_dir, SQL["op12_exact_dedup"])
    assert collected(op12_exact_dedup(spark, sf_dir), *names) == sorted(want, key=repr)


@pytest.mark.parametrize("way", range(3))
def test_odd_rows_and_clashing_columns(spark, way):
    rows = odd_rows() + [(30, "SAME TEXT HERE\nand again", "en", "a", 1), (31, "Ä ÄB", "en", "a", 1),
                         (32, "ä äb", "en", "a", 1), (2**53 + 1, "large id", "en", "a", 1), (2**53, "Large ID", "", "", 1)]
    got = exact_dedup(documents(spark, rows, clashing=True), historical=WAYS[way], hot=1)
    assert collected(got, *COLUMNS) == brute(rows)


@pytest.mark.parametrize(("way", "hot"), [(0, 1), (1, 3), (2, 1), (2, 3), (2, 1_000)])
def test_many_shards_and_hot_texts(spark, way, hot):
    dice = random.Random(way)
    rows = [(dice.randrange(900), dice.choice(["hot text", f"text {dice.randrange(200)}"]), "en", "s", 1)
            for _ in range(600)]
    got = exact_dedup(documents(spark, rows).repartition(5), historical=WAYS[way], shard_rows=16, hot=hot)
    assert collected(got, *COLUMNS) == brute(rows)
    assert got.filter("kept").count() == len({text for _, text, *_ in rows})


def test_ids_without_any(spark):
    got = exact_dedup(documents(spark, [(None, "a", "", "", 1)] * 3), hot=1)
    assert collected(got, *COLUMNS) == brute([(None, "a")] * 3)


def test_empty_table(spark):
    assert exact_dedup(documents(spark, [])).count() == 0


def digests(n, start=0):
    return [hashlib.sha256(str(i).encode()).digest() for i in range(start, start + n)]


@pytest.mark.parametrize("n", [0, 1, 2, 1_000])
def test_hash_is_minimal_and_perfect(n):
    keys = words_of(digests(n))
    assert sorted(PerfectHash.of(keys).slots(keys).tolist()) == list(range(n))


def test_a_digest_that_differs_in_one_byte_is_no_member():
    own = digests(500)
    frame = pd.DataFrame({"digest": own, "id": range(500), "known": True, "place": range(500), "n": 1})
    table = Table.read(Table.of(frame).row())
    near = [d[:-1] + bytes([d[-1] ^ 1]) for d in own]
    assert (table.find(words_of(near)) == -1).all() and (table.find(words_of(digests(500, 500))) == -1).all()
    at = table.find(words_of(own))
    assert np.array_equal(table.ids[at], np.arange(500)) and sorted(at) == list(range(500))
