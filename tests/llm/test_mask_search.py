import math
import random
import re
from collections import Counter

import numpy as np
from helpers import LOWER, collected, documents, duck_rows, odd_rows
from spanveil.llm.mask_search import Best, Block, block_row, ranked_search, search_block
from spanveil.llm.queries import SQL, op13_lexical_search

ITEMS = "item_id long, text string"
COLUMNS = ["item_id", "rank", "doc_id", "score"]
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, items, k):
    docs = [(r[0], Counter(TERM.findall((r[1] or "").translate(LOWER)))) for r in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for doc_id, c in docs:
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((10**9 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * c.total() * n_docs // n_terms)))
                for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_equals_sql(spark, sf_dir):
    names, want = duck_rows(sf_dir, SQL["op13_lexical_search"])
    assert collected(op13_lexical_search(spark, sf_dir), *names) == sorted(want, key=repr)


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows() + [(40 + i, f"some text {i % 3} Word", "en", "s", 1) for i in range(9)]
    items = [(1, "text text WORD same"), (1, "text text WORD same"), (2, None), (3, ""), (4, "..."), (5, "nowhere"),
             (None, "again id"), (6, "日本 ünï Ünï x1")]
    got = ranked_search(documents(spark, rows, clashing=True), spark.createDataFrame(items, ITEMS), k=4, block=5)
    assert collected(got, *COLUMNS) == brute(rows, items, 4)


def test_small_blocks_slices_and_ties(spark):
    dice = random.Random(5)
    vocabulary = [f"w{i}" for i in range(80)]
    rows = [(i // 2, " ".join(dice.choices(vocabulary, k=dice.randrange(1, 60))), "en", "s", 1) for i in range(400)]
    rows += [(900 - i, "w1 w2 w3", "en", "s", 1) for i in range(50)]
    items = [(i, " ".join(dice.choices(vocabulary, k=n))) for i, n in enumerate([1, 2, 3, 5, 8, 40, 200])]
    got = ranked_search(documents(spark, rows).repartition(3), spark.createDataFrame(items, ITEMS), k=10, block=37,
                        query_bytes=30)
    assert collected(got, *COLUMNS) == brute(rows, items, 10)


def test_empty_tables(spark):
    none, one = documents(spark, []), documents(spark, [(1, "a", "en", "s", 1)])
    assert ranked_search(none, spark.createDataFrame([(1, "a")], ITEMS)).count() == 0
    assert ranked_search(one, spark.createDataFrame([], ITEMS)).count() == 0


def packed(texts, terms):
    own = [[terms.index(t) for t in text.split() if t in terms] for text in texts]
    found = [np.unique(np.array(o, dtype=np.int32), return_counts=True) for o in own]
    return block_row(list(range(len(texts))), [len(t.split()) for t in texts],
                     [np.full(len(f[0]), i, dtype=np.int32) for i, f in enumerate(found)],
                     [f[0] for f in found], [f[1] for f in found])


def test_masks_that_cannot_reach_the_best_are_not_scored():
    texts = ["a b c"] * 100 + ["a x y"] * 3_000
    block, best = Block(packed(texts, ["a", "b", "c"]), 3_100, 9_300), Best(20)
    scored = search_block(block, np.array([0, 1, 2]), np.array([1, 500, 500]), best)
    assert scored == 100 and len(best.rows) == 20 and [i for *_, i in best.rows] == list(range(20))


def test_masks_of_more_terms_than_a_word_has_bits():
    dice = random.Random(9)
    terms = [f"t{i:03}" for i in range(100)]
    texts = [" ".join(dice.sample(terms, 60)) for _ in range(60)] * 2
    block = Block(packed(texts, terms), len(texts), 7_200)
    masks, groups = block.groups(np.arange(100))
    want = Counter(tuple(t in text.split() for t in terms) for text in texts)
    assert Counter({tuple(m.astype(bool).tolist()): len(g) for m, g in zip(masks, groups)}) == want
